"""Mixing sources to weights that vary over training (operator 9).

Position t runs from 0 to 1 over the training run. A schedule gives each source a weight at some
positions; between them weights are linear, before the first and behind the last they are constant, and at every t they are scaled
to add up to 1. A source that the schedule does not name has its natural share of all tokens as its
weight. Without a schedule the weights move linearly from a mixture of the natural shares and equal
ones (`flatten`: how much of the latter) at t = 0 to the natural shares at t = 1.

Integrating w gives the part D(t) of the run's tokens that a source has been asked for up to t; it is
a quadratic between neighbouring positions of the schedule, and inverted in closed form. A run has as many
tokens as there are, N. A source of `supply` tokens is asked for N * D(1) of them, that is for

    epochs = N * D(1) / supply

passes over its documents. Scarce sources are repeated, but at most `most_epochs` times, and rich ones are
used at least `least_epochs` times (1: no document is ever left out); between these bounds the run keeps to the target weights
exactly, and beyond them a source's weight is scaled to what its passes supply. So a tiny source
neither shortens the run of the others nor fills it. With both bounds 1 every document stands exactly once.

A document of pass k stands where D reaches the tokens of its source up to its middle:
D(t) / D(1) = (k + tokens up to its middle / supply) / epochs. Within a source documents come in the
order of a hash of their ids; of the last, partial pass those that fit into it as a whole are used. Documents are then
range-sorted by position.

Sums over a source never meet in one task, however large the source: documents are put into
buckets by the leading bits of their hash, tokens are summed by bucket, and only the order
within a bucket is cumulated by a window. There is no sampling for the sort either: positions spread
nearly evenly by construction where the schedule can be kept to, so range k of n is [k/n, (k+1)/n).

Result of `positions`: doc_id, source, tokens, epoch (0, 1, ...), position; `mix` returns
all columns of the documents, sorted, then epoch and position (in place of columns of these names).

Tokens are runs of non-blank characters. Defined results: a null source is a source of its own; a
null or empty text has 0 tokens and stands where its predecessor ends; a source without any token stands once, at the beginning; a
source of weight 0 throughout stands at the beginning of the run, as often as least_epochs says; null ids have no place and
are left out; ids are cast to bigint, and one that is no number is an error; rows of one id are all placed, and get their positions in the order of their texts' lengths; an empty table
gives an empty one; other columns keep their names, whatever these are. A schedule with a negative weight, with a position
outside [0, 1], with two weights of a source at one position, or with more than TIMES different positions is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm import words as W
from loomtext.llm.tables import materialized, small_batches

FLATTEN = 0.2
LEAST_EPOCHS, MOST_EPOCHS = 1.0, 4.0
TIMES = 1000
BUCKET_ROWS = 20_000  #: documents aimed at for a bucket of a window
_ID_HASH = "substring(md5(cast(doc_id AS string)), 1, 15)"
SCHEDULE = "source string, t double, weight double"


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens, h (the place in the source's order, 60 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for i, j, buf, off in W.text_slices(b.column(2)):
                _, _, ptr = W.find_words(buf, off)
                n[i:j] = np.diff(ptr)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], ["doc_id", "source", "tokens"])

    slim = small_batches(docs).filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return slim.mapInArrow(run, "doc_id bigint, source string, tokens bigint").withColumn("h", F.expr(f"cast(conv({_ID_HASH}, 16, 10) AS bigint)"))


def times_of(schedule: DataFrame) -> list[float]:
    """The positions of a schedule, after its rows were looked through; 0 and 1 are always among them."""
    bad = schedule.filter("t IS NULL OR weight IS NULL OR NOT (t BETWEEN 0 AND 1) OR NOT (weight >= 0 AND weight < double('Infinity'))")
    if not bad.isEmpty():
        raise ValueError("a schedule has weights of 0 or more at positions from 0 to 1")
    if not schedule.groupBy("source", "t").count().filter("count > 1").isEmpty():
        raise ValueError("a schedule has one weight of a source at a position")
    times = [r[0] for r in schedule.select("t").distinct().limit(TIMES + 1).collect()]
    if len(times) > TIMES:
        raise ValueError(f"a schedule has at most {TIMES} different positions")
    return sorted({0.0, 1.0, *times})


def weight_at(knots: Column, t: Column) -> Column:
    """The weight at t between the knots (t, weight) of a source, which are in order."""
    before, after = F.filter(knots, lambda k: k["t"] <= t), F.filter(knots, lambda k: k["t"] >= t)
    a, b = F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))
    between = a["weight"] + (b["weight"] - a["weight"]) * (t - a["t"]) / (b["t"] - a["t"])
    return F.when(a.isNull(), b["weight"]).when(b.isNull() | (a["t"] == b["t"]), a["weight"]).otherwise(between)


def demands(per: DataFrame, schedule: DataFrame | None, flatten: float) -> DataFrame:
    """`per` (source, supply, all, sources) with the arrays times, w (weights at them) and d (their integral)."""
    share = F.col("supply").cast("double") / F.col("all").cast("double")
    if schedule is None:
        first = F.when(F.col("supply") > 0, share + F.lit(flatten) * (F.lit(1.0) / F.col("sources").cast("double") - share)).otherwise(0.0)
        per, times = per.withColumn("w", F.array(first, share)), [0.0, 1.0]
    else:
        times = times_of(schedule)
        knots = schedule.groupBy(F.col("source").alias("named")).agg(F.sort_array(F.collect_list(F.struct("t", "weight"))).alias("knots"))
        at = F.array(*[F.lit(t) for t in times])
        given = F.when(F.col("knots").isNotNull(), F.transform(at, lambda t: weight_at(F.col("knots"), t))).otherwise(F.transform(at, lambda _: share))
        raw = per.join(knots, per.source.eqNullSafe(knots.named), "left").select(*per.columns, given.alias("raw"))
        sums = raw.filter("supply > 0").select(F.posexplode("raw").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
        sums = sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("sums"))  # one row, of at most TIMES + 2 numbers
        scaled = F.zip_with("raw", "sums", lambda x, s: F.when(s > 0, x / s).otherwise(0.0))
        per = raw.join(F.broadcast(sums), how="left").select(*per.columns, F.when(F.col("supply") > 0, scaled).otherwise(F.transform("raw", lambda _: F.lit(0.0))).alias("w"))
    places = F.array(*[F.lit(t) for t in times])
    d = F.array(F.lit(0.0))
    steps = F.transform(F.sequence(F.lit(1), F.lit(len(times) - 1)), lambda k: (F.get("w", k - 1) + F.get("w", k)) / F.lit(2.0) * (F.get(places, k) - F.get(places, k - 1)))
    d = F.aggregate(steps, d, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return per.withColumn("times", places).withColumn("d", d)


def place(y: Column, times: Column, w: Column, d: Column) -> Column:
    """The t at which the integral reaches y."""
    j = F.greatest(F.size(F.filter(d, lambda x: x < y)) - 1, F.lit(0))
    j = F.least(j, F.size(d) - 2)
    t0, w0, rest = F.get(times, j), F.get(w, j), y - F.get(d, j)
    slope = (F.get(w, j + 1) - w0) / (F.get(times, j + 1) - t0)
    root = w0 + F.sqrt(F.greatest(w0 * w0 + F.lit(2.0) * slope * rest, F.lit(0.0)))  # without cancellation, and for slope = 0 too
    return F.least(t0 + F.when(root > 0, F.lit(2.0) * rest / root).otherwise(0.0), F.lit(1.0))


def positions(docs: DataFrame, schedule: DataFrame | Iterable[tuple] | None = None, flatten: float = FLATTEN, least_epochs: float = LEAST_EPOCHS, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """The places of documents in the run: see the module. schedule: (source, t, weight)."""
    if not 0 <= least_epochs <= most_epochs:
        raise ValueError("0 <= least_epochs <= most_epochs is needed")
    if schedule is not None and not isinstance(schedule, DataFrame):
        schedule = docs.sparkSession.createDataFrame([(s, float(t), float(w)) for s, t, w in schedule], SCHEDULE)
    counted = materialized(token_counts(docs), "tokens")
    rows = counted.count()
    bits = max(0, min(40, int(np.ceil(np.log2(max(1, rows / BUCKET_ROWS))))))
    counted = counted.withColumn("b", F.shiftrightunsigned("h", 60 - bits))
    sums = counted.groupBy("source", "b").agg(F.sum("tokens").alias("n"))
    per = sums.groupBy("source").agg(F.sum("n").alias("supply"))
    totals = per.filter("supply > 0").agg(F.coalesce(F.sum("supply"), F.lit(1)).alias("all"), F.greatest(F.count("*"), F.lit(1)).alias("sources"))
    per = per.join(F.broadcast(totals))  # one row
    per = demands(per, schedule, flatten)
    whole = F.element_at("d", -1)
    asked = F.col("all").cast("double") * whole / F.col("supply").cast("double")
    epochs = F.when(F.col("supply") > 0, F.greatest(F.least(asked, F.lit(float(most_epochs))), F.lit(float(least_epochs)))).otherwise(F.lit(1.0))
    per = per.select("source", "supply", "times", "w", "d", epochs.alias("epochs"))
    # what comes before each bucket: by source over its buckets, of which there are few
    before = sums.select("source", "b", (F.sum("n").over(Window.partitionBy("source").orderBy("b")) - F.col("n")).alias("before"))
    starts = before.join(per, before.source.eqNullSafe(per.source)).select(before.source.alias("s2"), F.col("b").alias("b2"), "before", "supply", "times", "w", "d", "epochs")
    w = Window.partitionBy("source", "b").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    run = counted.withColumn("ahead", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    run = run.join(starts, run.source.eqNullSafe(starts.s2) & (run.b == starts.b2))
    supply, ahead = F.col("supply").cast("double"), F.col("before") + F.col("ahead")
    run = run.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs") - 1, F.lit(0)).cast("int"))))
    end = F.when(F.col("supply") > 0, F.col("epoch") + (ahead + F.col("tokens")).cast("double") / supply).otherwise(F.lit(0.0))
    run = run.filter(end <= F.col("epochs") * F.lit(1.0 + 1e-9))
    part = (F.col("epoch") + (ahead.cast("double") + F.col("tokens").cast("double") / F.lit(2.0)) / supply) / F.col("epochs")
    at = F.when((F.col("supply") > 0) & (whole > 0), place(part * whole, F.col("times"), F.col("w"), F.col("d"))).otherwise(F.lit(0.0))
    return run.select("doc_id", "source", "tokens", "epoch", at.alias("position"))


def mix(docs: DataFrame, schedule: DataFrame | Iterable[tuple] | None = None, flatten: float = FLATTEN, least_epochs: float = LEAST_EPOCHS, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """The documents that have an id, as often as they stand in the run, range-sorted by position: see the module."""
    spark = docs.sparkSession
    where = positions(docs, schedule, flatten, least_epochs, most_epochs)
    where = where.select("doc_id", "epoch", "position", F.row_number().over(Window.partitionBy("doc_id", "epoch").orderBy("position")).alias("copy"))
    row = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so no name can clash
    numbered = row.withColumn("copy0", F.row_number().over(Window.partitionBy("id").orderBy(F.length("row.text"), F.xxhash64("row.text"))))
    # the copy is compared by a difference, so that the ids alone are the key and one exchange of the texts serves window and join
    placed = numbered.join(where, (F.col("id") == F.col("doc_id")) & ((F.col("copy0") - F.col("copy")) == 0))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.least(F.floor(F.col("position") * n), F.lit(n - 1)).cast("int")
    ranged = placed.repartitionById(n, part).sortWithinPartitions("position", "id", "epoch", "copy")
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("epoch", "position")]
    return ranged.select(*columns, "epoch", "position")


def as_written(docs: DataFrame) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """The rows of `docs` (doc_id, text, others), a table of Parquet files that Spark wrote, in the order in which they were written, with `position`, and what
    finishes the batches of a partition (with text and position): it turns `position`, the tokens before the row's file, into the part of all tokens up to the middle of the row's.
    It runs in the function that uses the rows, as a function of its own would be a second Python process for each task.
    Any other `docs` is written first. Files are as many as the partitions that wrote them; a few numbers of each go to the driver."""
    spark = small_batches(docs).sparkSession
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":  # only of files themselves are names and rows known
        docs = materialized(docs, "in-order")
    name = F.col("_metadata.file_name")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = sum(int(W.find_words(buf, off)[2][-1]) for _, _, buf, off in W.text_slices(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([words][: b.num_rows], pa.int64())], ["name", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a batch may end one file and begin the next
            names = b.column(0).dictionary_encode()
            for k in range(len(names.dictionary)):
                yield from count([b.filter(pc.equal(names.indices, k))])

    number = lambda pattern: F.coalesce(F.regexp_extract("name", pattern, 1).try_cast("bigint"), F.lit(0))
    sums = docs.select(name.alias("name"), "text").mapInArrow(pieces, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    files = sorted((r["part"], r["piece"], r["name"], r["n"]) for r in sums.select("name", "n", number(r"^part-(\d+)").alias("part"), number(r"-c(\d+)\.").alias("piece")).collect())
    total, ahead, ranked = sum(f[3] for f in files), 0, []
    for k, (_, _, file, words) in enumerate(files):
        ranked.append((file, k, ahead))
        ahead += words
    ranked = F.broadcast(spark.createDataFrame(ranked, "__file string, __rank bigint, __ahead bigint"))

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = -1  # tokens before the row; the files of a partition follow each other
        for b in batches:
            if not b.num_rows:
                continue
            text, ahead = b.column("text"), b.column("position")
            n = np.zeros(b.num_rows, np.int64)
            for i, j, buf, off in W.text_slices(text):
                n[i:j] = np.diff(W.find_words(buf, off)[2])
            before = int(ahead[0].as_py()) if before < 0 else before
            middle = before + np.cumsum(n) - n / 2
            before += int(n.sum())
            yield b.set_column(b.schema.get_field_index("position"), "position", pa.array(middle / max(1, total)))

    n = max(1, min(len(files), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "position"]
    rows = docs.select(*columns, name.alias("__name"), F.col("_metadata.row_index").alias("__row")).join(ranked, F.col("__name") == F.col("__file"))
    rows = rows.repartitionById(n, F.floor(F.col("__rank") * n / F.lit(max(1, len(files)))).cast("int")).sortWithinPartitions("__rank", "__row")
    return rows.select(*columns, F.col("__ahead").cast("double").alias("position")), place_rows


def in_order(docs: DataFrame) -> DataFrame:
    """Each document once, with its columns alone, in the order of the curriculum."""
    return mix(docs, least_epochs=1.0, most_epochs=1.0).select(*[f"`{c}`" for c in docs.columns if c not in ("epoch", "position")])
