"""Services reached over HTTP, by a transport that a deployment may replace."""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: (method, url, headers, body) -> (status, text)
Transport = Callable[[str, str, dict[str, str], bytes | None], tuple[int, str]]
RESULT = "code string, data string, msg string"


def urllib_transport(method: str, url: str, headers: dict[str, str], body: bytes | None) -> tuple[int, str]:
    request = urllib.request.Request(url, data=body, headers=headers, method=method)
    with urllib.request.urlopen(request, timeout=60) as answer:
        return answer.status, answer.read().decode()


class OlapService:
    """An OLAP service's REST calls: any call, a model suggested from queries, a segment built."""

    def __init__(self, spark: SparkSession, base: str, user: str, password: str, transport: Transport = urllib_transport):
        token = base64.b64encode(f"{user}:{password}".encode()).decode()
        self.spark, self.base, self.transport = spark, base.rstrip("/"), transport
        self.headers = {"Authorization": f"Basic {token}", "Content-Type": "application/json;charset=utf-8"}

    def call(self, method: str, path: str, body: dict | None = None, headers: dict[str, str] | None = None) -> DataFrame:
        """(code, data, msg) of one call."""
        if method.upper() not in ("GET", "POST", "PUT"):
            raise ValueError(f"unknown method: {method}")
        payload = None if body is None else json.dumps(body).encode()
        status, text = self.transport(method.upper(), f"{self.base}/{path.lstrip('/')}", {**self.headers, **(headers or {})}, payload)
        try:
            found = json.loads(text)
        except ValueError:
            found = {"code": str(status), "data": text, "msg": ""}
        row = (str(found.get("code", status)), found["data"] if isinstance(found.get("data"), str) else json.dumps(found.get("data")), str(found.get("msg") or ""))
        return self.spark.createDataFrame([row], RESULT)

    def suggest_model(self, project: str, sqls: list[str], **options) -> DataFrame:
        return self.call("POST", "api/models/model_suggestion", {"project": project, "sqls": sqls, **options})

    def build_segment(self, project: str, model: str, start: int, end: int) -> DataFrame:
        return self.call("POST", f"api/models/{model}/segments", {"project": project, "start": str(start), "end": str(end)})


def source_tables(spark: SparkSession, sql: str) -> list[str]:
    """Names of the tables and views that a query reads, from its unresolved plan."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found, ctes = set(), set()

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            found.add(node.tableName().replace("`", ""))
        if kind == "UnresolvedWith":
            for k in range(node.cteRelations().size()):
                entry = node.cteRelations().apply(k)
                ctes.add(entry._1())
                walk(entry._2())
        for seq in (node.children(), node.innerChildren()):
            for k in range(seq.size()):
                child = seq.apply(k)
                if hasattr(child, "children"):
                    walk(child)

    walk(plan)
    return sorted(found - ctes)


def upload(df: DataFrame, url: str, transport: Transport = urllib_transport, headers: dict[str, str] | None = None) -> None:
    """Rows as JSON lines to an address, one call a partition."""

    def send(rows):
        body = "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in rows)
        if body:
            transport("POST", url, {"Content-Type": "application/x-ndjson", **(headers or {})}, body.encode())

    df.foreachPartition(send)
