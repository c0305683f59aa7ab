"""Readers: harness tables, pages of documents, rules as rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.auxiliary import Auxiliary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Rule:
    """A check rule: what to find, and the conditions its matches must meet."""

    ord: int
    find: str
    replace: str = ""
    regex: bool = False
    enabled: bool = True
    leading_boundary: bool = False
    category: str = "spelling"
    finds: tuple[str, ...] = field(default=())
    exclude_prefixes: tuple[str, ...] = ()
    exclude_phrases: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    auxiliary: Auxiliary | None = None

    def pattern(self) -> str:
        """The regular expression: itself, the literal, the alternation of its variants, longest first, or that of an auxiliary verb."""
        if self.auxiliary:
            return self.auxiliary.pattern()
        if self.finds:
            return "|".join(literal(x) for x in sorted(self.finds, key=lambda x: (-len(x), x)))
        return self.find if self.regex else literal(self.find)


def literal(text: str) -> str:
    """A regular expression that matches just this text; any run of blanks matches any other."""
    return " +".join("".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in part) for part in text.split(" "))


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_num, start, line): lines of each text and the offset at which each begins."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    one_more = lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))
    # Offsets by blocks of 256 lines: an array that grows by one line at a time is copied each time, so it has to stay short.
    split = docs.select(key, F.split("text", "\n", -1).alias("all"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / 256).cast("int")), lambda b: F.slice("all", b * 256 + 1, F.lit(256)))
    sizes = F.transform(F.col("blocks"), lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + F.length(x) + 1))
    split = split.where(F.size("all") > 0).select(key, blocks.alias("blocks")).select(key, "blocks", sizes.alias("sizes"))
    each = split.select(key, F.aggregate("sizes", empty, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")))["starts"].alias("base"), "blocks")
    each = each.select(key, F.posexplode(F.arrays_zip("base", "blocks")).alias("block", "x")).select(key, "block", F.col("x.base").alias("base"), F.col("x.blocks").alias("part"))
    placed = each.select(key, "block", "base", F.posexplode(F.arrays_zip(F.aggregate("part", empty, one_more)["starts"].alias("start"), F.col("part").alias("line"))).alias("k", "x"))
    return placed.select(key, (F.col("block") * 256 + F.col("k")).alias("line_num"), (F.col("base") + F.col("x.start")).alias("start"), F.col("x.line").alias("line"))
