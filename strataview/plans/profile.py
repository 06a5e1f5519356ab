"""Profiling: from a DataFrame and a probe to a spec.

One scan of the facts fills a state for each node and task (``operators.accumulate``); these are written once, and all tables of the spec are
merges of them.  Nothing but states is shuffled, and nothing is broadcast.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataview.functions.hashing import hash32
from strataview.functions.hierarchy import path_above
from strataview.operators.accumulate import merged_tables, node_states
from strataview.operators.flatten import facts as make_facts
from strataview.operators.flatten import field_paths, record_fields
from strataview.operators.sketches import NODE, estimates
from strataview.plans.options import Options, make_options
from strataview.plans.progress import Progress, Report, status_line
from strataview.plans.selectors import normalize_probe, select
from strataview.plans.spec import RawSpec, united_meta
from strataview.sources.tables import shared_folder


def probe_facts(df: DataFrame, probe=0, options: Options | None = None, where=None) -> DataFrame:
    """The facts of a probe, with columns __ts, __key and the hash h."""
    options = options or Options(limit=None)
    selector, attrs = normalize_probe(probe)
    if options.limit is not None:
        df = df.limit(options.limit)
    if where is not None:
        df = df.where(where)
    chosen = select(df, selector)
    if isinstance(chosen.dtype, T.NullType):
        df = df.limit(0)
    elif not (isinstance(selector, (int, tuple, list)) and selector in (0, (), [])):
        df = df.where(chosen.ok)

    def attribute(name: str):
        if name not in attrs:
            return F.lit(None).cast("string").alias(f"__{name}")
        found = select(df, attrs[name])
        return F.when(found.ok, found.value).alias(f"__{name}")

    columns = [F.col(f"`{c}`") for c in df.columns]
    source = df.select(*columns, attribute("ts"), attribute("key")) if attrs else df.withColumns({"__ts": F.lit(None).cast("string"), "__key": F.lit(None).cast("string")})
    flat = make_facts(source, chosen.value, chosen.dtype, options.name, options.categorical, ("__ts", "__key"), options.variant_depth)
    return flat.withColumn("h", hash32(F.col("vtext"), options.hash))


def fixed_rows(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as they are now: written once where the session has a checkpoint folder, else kept in memory.

    A limit may pick other rows each time it is evaluated, and a profile reads its input several times.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def states_of(df: DataFrame, probe, options: Options, where=None, count=None) -> DataFrame:
    """Node states of the records of ``df``, which is read once; ``count``: an accumulator of records."""
    found = probe_facts(df, probe, options, where)
    if not options.hll_b and not options.samples:
        found = found.withColumn("h", F.lit(None).cast("long"))  # hashes serve sketches and samples alone
    return node_states(found, options.hll_b, options.sample_size, bool(options.samples), count)


def kept_states(states: DataFrame) -> DataFrame:
    """``states`` filled by one job and written; the merges of a spec run side by side and would each fill states that are not there yet."""
    spark = states.sparkSession
    path = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    states.write.parquet(path)
    return spark.read.schema(states.schema).parquet(path)


def meta_of(df: DataFrame, probe, options: Options) -> dict:
    """Metadata of a run that begins now."""
    started = datetime.datetime.now(datetime.timezone.utc).isoformat()
    dtype = select(df, normalize_probe(probe)[0]).dtype
    records = [list(r) for r in record_fields(dtype, options.name)]
    return {**asdict(options), "probe": repr(probe), "fields": field_paths(dtype), "records": records, "started": started, "processed": None, "truncated": []}


def spec_of(states: DataFrame, options: Options, meta: dict) -> RawSpec:
    """The spec that node states add up to."""
    tables = merged_tables(states, options.hll_b, options.sample_size, bool(options.samples))
    if options.dict_cap is not None:
        order = Window.partitionBy(*NODE).orderBy(F.desc("n"), "vtext")
        tables["dictionary"] = tables["dictionary"].withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= options.dict_cap).drop("__r")
    return RawSpec(**tables, meta=meta)


def cut_paths(spec: RawSpec, options: Options) -> list[str]:
    """Paths at which something was left out: capped dictionaries, and variants below the depth that was asked for."""
    cut = set()
    if options.dict_cap is not None:
        cut |= {r["path"] for r in spec.dictionary.groupBy("path", "class").count().where(F.col("count") >= options.dict_cap).collect()}
    if options.variant_depth is not None:
        # below a list of class "list", and below a map without any child, nothing was looked at
        nodes = spec.nodes.select("path", "class").collect()
        above = {path_above(r["path"]) for r in nodes}
        cut |= {r["path"] for r in nodes if r["class"] == "list" or (r["class"] == "map" and r["path"] not in above)}
    return sorted(cut)


def profile(df: DataFrame, probe=0, where=None, report: Report = status_line, **given) -> RawSpec:
    """Profile ``df``: ``probe`` is a selector or (selector, {"ts": ..., "key": ...}).

    The input is read at once, and only once; with the option ``progress``, ``report(records, seconds)`` is called at that interval meanwhile.
    """
    options = make_options(**given)
    meta = meta_of(df, probe, options)
    if options.limit is not None:
        df = fixed_rows(df.limit(options.limit))
    count = df.sparkSession.sparkContext.accumulator(0) if options.progress else None
    states = states_of(df, probe, options, where, count)
    if count is not None:
        with Progress(count, float(options.progress), report):
            states = kept_states(states)
    else:
        states = kept_states(states)
    spec = spec_of(states, options, meta)
    if options.output_path:
        spec = spec.with_meta(processed=df.count(), ended=datetime.datetime.now(datetime.timezone.utc).isoformat(), truncated=cut_paths(spec, options))
        spec.save(options.output_path, "overwrite")
    return spec


def profile_variants(variants: list[DataFrame], probe=0, where=None, **given) -> RawSpec:
    """Profile records of several schemas as one table (see ``sources.variants``): each is read once, by its own fields.

    Records of different sizes are nodes of their own; the metadata's ``records`` keep every list of field names, also those of one name and size.
    A record whose schema lacks the selected field is not explored.  ``limit`` counts the records of all schemas, the first ones first.
    """
    if not variants:
        raise ValueError("no records of any schema")
    options = make_options(**given)
    meta = united_meta([meta_of(df, probe, options) for df in variants])
    left, kept = options.limit, []
    for df in variants:
        if left is not None:
            df = fixed_rows(df.limit(left))
            left -= df.count()
        kept.append(df)
    states = kept_states(reduce(DataFrame.unionByName, (states_of(df, probe, options, where) for df in kept)))
    spec = spec_of(states, options, meta)
    if options.output_path:
        ended = datetime.datetime.now(datetime.timezone.utc).isoformat()
        spec = spec.with_meta(processed=sum(df.count() for df in kept), ended=ended, truncated=cut_paths(spec, options))
        spec.save(options.output_path, "overwrite")
    return spec


def cardinalities(spec, b: int | None = None) -> DataFrame:
    """(path, class, n, cardinality, error) of every node."""
    b = b or spec.meta["hll_b"]
    if not b or spec.registers is None:
        return spec.nodes.select(*NODE, "n", F.lit(0).cast("long").alias("cardinality"), F.lit(0).cast("long").alias("error"))
    from strataview.operators.sketches import clamp_cardinality, error_estimate

    est = estimates(spec.registers, b)
    got = spec.samples.groupBy(*NODE).agg(F.count("*").alias("s")) if spec.samples is not None else spec.nodes.limit(0).select(*NODE, F.lit(0).alias("s"))
    joined = spec.nodes.join(est, NODE, "left").join(got, NODE, "left")
    value = clamp_cardinality(F.coalesce("estimate", F.lit(0.0)), F.coalesce("s", F.lit(0)), F.col("n"))
    return joined.select(*NODE, "n", value.alias("cardinality"), F.floor(F.coalesce("estimate", F.lit(0.0)) * error_estimate(b) + 0.5).cast("long").alias("error"))
