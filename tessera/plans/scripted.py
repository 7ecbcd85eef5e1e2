"""Queries that go through scripts: sources, commands, fitted functions, models and stores."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from ..context import ScriptContext
from .catalog import ORACLES, QUERIES, _binned, _round_trip, _scratch, query, table


def _context(spark: SparkSession, sf_dir: str, *names: str) -> tuple[ScriptContext, str]:
    """A context with tables of ``sf_dir`` as ``q_<name>``, and a scratch folder that executors share."""
    ctx = ScriptContext(spark)
    for name in names:
        ctx.publish(table(spark, sf_dir, name), f"q_{name}")
    path = _scratch(spark, "script")
    ctx.variables["metaPath"] = f"{path}/meta"
    return ctx, path


for _fmt, _where in (("excel", 'where header="true" and inferSchema="true"'), ("xml", 'where rowTag="nation" and rootTag="nations"')):
    QUERIES[f"source_{_fmt}"], ORACLES[f"source_{_fmt}"] = _round_trip(_fmt, _where), "select n_nationkey::bigint as k, n_name as name from nation"


@query("""select o_orderkey as k, o_orderdate::date as day, o_totalprice::decimal(12, 2) as exact, o_totalprice > 100000 as large, nullif(o_orderstatus, 'F') as status,
    case when o_custkey % 3 = 0 then null else o_totalprice end as gap from orders""")
def source_types(spark, sf_dir):
    """Dates, decimals, booleans and nulls of a whole table, saved and loaded in three formats one after the other."""
    ctx, path = _context(spark, sf_dir, "orders")
    ctx.run(f"""
        select o_orderkey as k, cast(o_orderdate as date) as day, cast(o_totalprice as decimal(12, 2)) as exact, o_totalprice > 100000 as large, nullif(o_orderstatus, 'F') as status,
            case when o_custkey % 3 = 0 then null else o_totalprice end as gap from q_orders as q_typed;
        save overwrite q_typed as delta.`{path}/d`; load delta.`{path}/d` as q_typed2;
        save overwrite q_typed2 as orc.`{path}/o`; load orc.`{path}/o` as q_typed3;
        save overwrite q_typed3 as parquet.`{path}/p`; load parquet.`{path}/p` as q_typed4;
    """)
    return ctx.table("q_typed4")


@query("select 'median' as step, quantile_disc(o_totalprice, 0.5)::double as value from orders union all select 'range', 250 union all select 'columns', count(*) - 2 from information_schema.columns where table_name = 'orders'")
def script_commands(spark, sf_dir):
    """Commands of a script; each result has a name."""
    ctx, _ = _context(spark, sf_dir, "orders")
    ctx.run("""
        !approxQuantile q_orders o_totalprice 0.5 named q_median;
        select * from q_orders as q_cut;
        !columns drop 'o_totalprice,o_orderstatus' from q_cut;
        !dataframe build range 250 named q_range;
        !last named q_range_again;
        select 'median' as step, value from q_median union all select 'range', cast(count(*) as double) from q_range_again as q_steps;
    """)
    width = len(ctx.table("q_cut").columns)
    return ctx.table("q_steps").unionByName(spark.createDataFrame([("columns", float(width))], "step string, value double"))


@query(f"""with b as ({_binned("l_extendedprice", "EF")}) select bin_id::double as bin, count(*) as n from b group by 1""")
def binning_function(spark, sf_dir):
    """Bins that a script fits, registers and calls as a SQL function over all lines."""
    ctx, path = _context(spark, sf_dir, "lineitem")
    return ctx.run(f"""
        select l_extendedprice, if(l_linestatus = 'F', 1, 0) as label from q_lineitem as q_rated;
        run q_rated as Binning.`{path}/bins` where selectedFeatures="l_extendedprice" and numBucket="5" as q_bins;
        register Binning.`{path}/bins` as bin_of_price;
        select bin_of_price(array(cast(l_extendedprice as string)))[0] as bin, count(*) as n from q_rated group by 1 as q_counts;
    """)


@query("""with e as (select list_sort(list_distinct(quantile_disc(l_extendedprice, [0.2, 0.4, 0.6, 0.8]))) as q from lineitem), k as (select q, unnest(range(len(q) + 1)) as k from e)
    select k::int as bin_id, case when k = 0 then '(-Infinity' else '[' || q[k]::varchar end || ', ' || case when k = len(q) then 'Infinity' else q[k + 1]::varchar end || ')' as value from k""")
def binning_intervals(spark, sf_dir):
    from ..operators import scoring

    df = table(spark, sf_dir, "lineitem").select("l_extendedprice", F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("label"))
    return scoring.woe_table(df, scoring.fit_bins(df, ["l_extendedprice"], "EF", 5)).select("bin_id", "value")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem")
def table_repartition(spark, sf_dir):
    """Rows dealt by range and again by hash stay the same rows."""
    ctx, _ = _context(spark, sf_dir, "lineitem")
    return ctx.run("""
        select l_orderkey, l_linenumber, l_partkey from q_lineitem as q_keys;
        run q_keys as TableRepartition.`` where partitionNum="5" and partitionType="range" and partitionCols="l_partkey" as q_ranged;
        run q_ranged as TableRepartition.`` where partitionNum="3" as q_dealt;
    """)


@query("select least(500, count(*)) as n, 0::bigint as strange from customer")
def take_sample(spark, sf_dir):
    """A sample by size has that many rows, all of them of the table."""
    ctx, _ = _context(spark, sf_dir, "customer")
    return ctx.run("""
        run q_customer as TakeRandomSampleExt.`` where size="500" as q_sample;
        select count(*) as n, count_if(c.c_custkey is null) as strange from q_sample s left join q_customer c on s.c_custkey = c.c_custkey and s.c_name = c.c_name as q_counts;
    """)


@query("select 2000 as n, 2000 as ids, 12 as width, 3 as labels, true as bounded")
def sample_dataset(spark, sf_dir):
    """A made table has the shape that was asked for."""
    ctx, _ = _context(spark, sf_dir)
    return ctx.run("""
        run command as SampleDatasetExt.`` where size="2000" and featuresSize="12" and labelSize="3" as q_made;
        select cast(count(*) as int) as n, cast(count(distinct id) as int) as ids, max(size(features)) as width, cast(count(distinct label) as int) as labels,
            bool_and(array_min(features) >= 0 and array_max(features) < 1) as bounded from q_made as q_shape;
    """)


@query("select conv_id, turn, 'echo: ' || text as answer from conversations where text is not null")
def llm_infer(spark, sf_dir):
    """A model registered as a function answers every turn; the built-in backend repeats it."""
    ctx, _ = _context(spark, sf_dir, "conversations")
    return ctx.run("""
        run command as LLM.`` where action="infer" and pretrainedModelType="llama" and udfName="ask_echo" as q_model;
        select conv_id, turn, llm_result(ask_echo(llm_param(map('instruction', text))[0])) as answer from q_conversations where text is not null as q_answers;
    """)


@query("""select event_id, '{"instruction": "' || event_type || '", "history": "[{\\"query\\": \\"q' || event_id || '\\"}]"}' as param from events""")
def llm_stack(spark, sf_dir):
    """The history of a call goes into the next call's parameters."""
    from ..functions import prompts

    prompts.register(spark)
    events = table(spark, sf_dir, "events")
    last = F.format_string('{"history": [{"query": "q%d"}]}', F.col("event_id"))
    fresh = F.format_string('{"instruction": "%s"}', F.col("event_type"))
    return events.select("event_id", F.get(F.call_function("llm_stack", F.array(last), F.array(fresh)), F.lit(0)).alias("param"))


_QA_CUT = r"""case when length(text) - {at} > 800 then coalesce(nullif(length(regexp_extract(substr(text, {at} + 1, 800), '(?s)^.*(?:\n|\. )')), 0), 800) else length(text) - {at} end"""


@query(f"""with recursive c as (select text, 0 as start, {_QA_CUT.format(at="0")} as n from (select coalesce(text, '') as text from documents where doc_id is not null)
    union all select text, start + n, {_QA_CUT.format(at="(start + n)")} from c where start + n < length(text))
    select md5(substr(text, start + 1, n)) as digest, count(*) as n from c group by 1""")
def qa_chunks(spark, sf_dir):
    """Whole texts chunked, embedded and stored for question answering, read back from the store."""
    ctx, _ = _context(spark, sf_dir, "documents")
    return ctx.run("""
        run q_documents as LLMQABuilder.`` where table="corpus" as q_chunks;
        select md5(content) as digest, count(*) as n from q_chunks group by 1 as q_digests;
    """)


_NEAR = "list_cosine_similarity(q.embedding::double[], e.embedding::double[])"


@query(f"""select query_id, vec_id, round(similarity, 4) as similarity from (select q.vec_id as query_id, e.vec_id, {_NEAR} as similarity,
    row_number() over (partition by q.vec_id order by {_NEAR} desc, e.vec_id) as r from embeddings q, embeddings e where q.vec_id % 20 = 0) where r <= 3""")
def vector_search(spark, sf_dir):
    """A vector table filled and searched by scripts; the queries are the rows whose id 20 divides."""
    ctx, _ = _context(spark, sf_dir, "embeddings")
    return ctx.run("""
        select vec_id as id, cast(vec_id as string) as content, cast(embedding as array<double>) as vector from q_embeddings as q_vectors;
        run command as Retrieval.`` where action="table/create" and table="near" as q_done;
        run q_vectors as Retrieval.`` where action="table/data" and table="near" as q_done2;
        select id, vector from q_vectors where id % 20 = 0 as q_wanted;
        run q_wanted as Retrieval.`` where action="search" and table="near" and k="3" as q_found;
        select query_id, vec_id, round(similarity, 4) as similarity from q_found as q_near;
    """)


