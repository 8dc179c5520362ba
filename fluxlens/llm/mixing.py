"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

A source's target over its size is the number of copies expected of each of its documents. The expected copies are summed
up along the source, ordered by size, one random offset is added, and a document is emitted once for each whole number
that its step crosses: at least the expected copies rounded down, at most rounded up. As sizes do not fall along the order,
the words taken from a source differ from its target by no more than its largest document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.running import running_sum
from fluxlens.llm.tasks import settled

#: Bits after the point of expected copies; whole numbers make sums exact in any order.
COPY_BITS = 40
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: Sequence[int], percent: int, most_copies: int) -> DataFrame:
    """Rows (nameless, name, source_size) with each source's `target`, a double.

    Sources take the weights in turn by code point (a null source last) and share `percent` of all sizes. A target stops at
    `most_copies` times the size, and the others share the excess by weight: target = min(most, level * weight), where
    the level is that of the first source, ordered by the level at which it is full, that is not full at it.
    """
    numbered = running_sum(sources.withColumn("one", F.lit(1).cast("long")), [], ["nameless", "name"], {"place": "one"})
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    weighed = numbered.withColumns(
        {
            "weight": F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")),
            "most": F.col("source_size") * most_copies,
        }
    ).withColumn("full_at", F.col("most") / F.col("weight"))
    filled = running_sum(weighed, [], ["full_at", "place"], {"most_upto": "most", "weight_upto": "weight"})
    all_sizes, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    left = F.lit(percent * (all_sizes or 0)) - (F.col("most_upto") - F.col("most")) * 100
    level = left / ((F.lit(all_weights) - F.col("weight_upto") + F.col("weight")) * 100)
    found = filled.select("full_at", "place", level.alias("level")).where("full_at >= level").agg(F.min_by("level", F.struct("full_at", "place"))).first()[0]
    full = F.lit(True) if found is None else F.col("full_at") <= F.lit(found)
    share = F.lit(0.0 if found is None else found) * F.col("weight")
    return weighed.select("nameless", "name", "source_size", F.when(full, F.col("most").cast("double")).otherwise(share).alias("target"))


def planned_copies(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    percent: int = 150,
    most_copies: int = 2,
    seed: int = 1,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, copies, taken, and the columns of `carry` as a struct `row`.

    The size is the number of words divided by space and 0x09-0x0D (null text: 0); `target` is the source's, `copies` says
    how often the mix takes the document, and `taken` = copies * size. The null source is one source, the last. A source
    without words has target 0 and is not taken. Identifiers may be null or repeated: each row counts for itself, and rows
    of equal source, size and identifier share their copies in any way. The offset follows from seed and source, so reruns
    agree. Other columns are not read unless carried; an empty table gives no rows.
    """
    source = F.col(source_column).cast("string")
    size = F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    columns = [
        F.col(id_column).cast("long").alias("doc_id"),
        source.isNull().alias("nameless"),
        F.coalesce(source, F.lit("")).alias("name"),
        size.alias("size"),
    ]
    sized = settled(documents.select(*columns, *([F.struct(*carry).alias("row")] if carry else [])))
    sources = settled(sized.groupBy("nameless", "name").agg(F.sum("size").alias("source_size")))
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * float(1 << COPY_BITS))).otherwise(0)
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("nameless").cast("string"), F.lit(":"), F.col("name")))
    known = source_targets(sources, weights, percent, most_copies).withColumns(
        {
            "step": expected.cast("decimal(20,0)"),
            "offset": F.conv(F.substring(drawn, 1, COPY_BITS // 4), 16, 10).cast("decimal(20,0)"),
        }
    )
    walked = running_sum(sized.join(known, ["nameless", "name"]), ["nameless", "name"], ["size", "doc_id"], {"walked": "step"})
    crossed = F.expr(f"((walked + offset) DIV {1 << COPY_BITS}BD) - ((walked - step + offset) DIV {1 << COPY_BITS}BD)")
    return walked.withColumn("copies", crossed).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else [])
    )


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: all columns of the documents, each document as often as `planned_copies` says (same options).

    The texts pass through the range shuffle of the running sum, so that repeated rows need no join to find their copies.
    """
    planned = planned_copies(documents, carry=documents.columns, **options)
    return planned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
