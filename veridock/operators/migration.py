"""Migration of a duplicated lineage: old rows matched one to one with new ones, and everything that refers to them rewritten, with proof."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions.canonical import row_text, table_digest
from veridock.operators.ranks import group_ranks
from veridock.sources.session import ensure_checkpoint_dir


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns, nulls marked."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def match_rounds(old: DataFrame, new: DataFrame, rounds: list[list[str]]) -> DataFrame:
    """old, new, round: rows (id and columns) matched one to one.

    A round pairs rows that agree in its columns, in order of id, where both sides
    have equally many that no earlier round has used; so strict rounds come first,
    and a group that differs in number stays open.
    """
    ensure_checkpoint_dir(old.sparkSession)
    done: list[DataFrame] = []
    for number, columns in enumerate(rounds, 1):
        left, right = (side.select("id", fingerprint(*columns).alias("__f")) for side in (old, new))
        for pairs in done:
            left, right = left.join(pairs.select(F.col("old").alias("id")), "id", "left_anti"), right.join(pairs.select(F.col("new").alias("id")), "id", "left_anti")
        a = group_ranks(left.select(F.col("id").alias("old"), "__f"), ["__f"], ["old"], "nth", "n")
        b = group_ranks(right.select(F.col("id").alias("new"), "__f"), ["__f"], ["new"], "nth", "n")
        done.append(a.join(b, ["__f", "nth", "n"]).select("old", "new", F.lit(number).alias("round")).checkpoint())
    return reduce(DataFrame.unionByName, done)


def unresolved(old: DataFrame, new: DataFrame, matches: DataFrame, base: list[str], reviewed: list[str]) -> DataFrame:
    """id, code, candidate of old rows without a match.

    REVIEWED_VALUE_CONFLICT: one new row alone agrees in the base columns and differs
    in a reviewed one; AMBIGUOUS: several agree; MISSING: none, or one that agrees in
    all and is taken.
    """
    open_rows = old.join(matches.select(F.col("old").alias("id")), "id", "left_anti").select("id", fingerprint(*base).alias("__b"), fingerprint(*reviewed).alias("__r"))
    one = F.when(F.count(F.lit(1)) == 1, F.min(F.struct("id", "__r")))
    groups = new.select("id", fingerprint(*base).alias("__b"), fingerprint(*reviewed).alias("__r")).groupBy("__b").agg(F.count(F.lit(1)).alias("n"), one.alias("only"))
    found = open_rows.join(groups, "__b", "left")
    differs = F.col("only.__r") != F.col("__r")
    code = F.when((F.col("n") == 1) & differs, "REVIEWED_VALUE_CONFLICT").when(F.col("n") > 1, "AMBIGUOUS").otherwise("MISSING")
    return found.select("id", code.alias("code"), F.when((F.col("n") == 1) & differs, F.col("only.id")).alias("candidate"))


def rewrite(table: DataFrame, columns: list[str], matches: DataFrame) -> DataFrame:
    """The table with old ids in the columns replaced by new ones; all else as it is."""
    out = table
    for k, column in enumerate(columns):
        ids = matches.select(F.col("old").alias(f"__old{k}"), F.col("new").alias(f"__new{k}"))
        out = out.join(ids, F.col(column) == F.col(f"__old{k}"), "left").withColumn(column, F.coalesce(f"__new{k}", column)).drop(f"__old{k}", f"__new{k}")
    return out.select(*table.columns)


@dataclass
class Migration:
    """What a migration has made: tables by name, and a proof (table, check, holds) of which every row must hold."""

    tables: dict[str, DataFrame]
    proof: DataFrame


def migrate(entities: dict[str, DataFrame], references: dict[str, list[str]], merged: str, matches: DataFrame, open_rows: DataFrame) -> Migration:
    """Drop the old rows of entity ``merged`` that have a match and rewrite all references to them.

    ``references`` names for each table its columns of ids of ``merged``. Nothing is
    done while any row is unresolved. The proof: rows that refer are as many as
    before, all but their ids is the same bag of rows, no reference leads to a row
    that went, and the merged table lost exactly the matched rows.
    """
    first = open_rows.first()
    if first is not None:
        raise ValueError(f"unresolved: {first['id']} is {first['code']}")
    gone = matches.select(F.col("old").alias("id"))
    tables = {n: rewrite(df, references[n], matches) if n in references else df for n, df in entities.items()}
    tables[merged] = tables[merged].join(gone, "id", "left_anti")
    checks = []

    def check(name: str, what: str, holds: DataFrame) -> None:
        checks.append(holds.select(F.lit(name).alias("table"), F.lit(what).alias("check"), F.coalesce("holds", F.lit(False)).alias("holds")))

    def counted(a: DataFrame, b: DataFrame, plus: DataFrame | None = None) -> DataFrame:
        sides = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "x"), (b, "y"), (plus if plus is not None else a.limit(0), "z"))]
        return sides[0].crossJoin(sides[1]).crossJoin(sides[2]).select((F.col("x") == F.col("y") + F.col("z")).alias("holds"))

    check(merged, "ROWS", counted(entities[merged], tables[merged], matches))
    for name, columns in references.items():
        before, after = entities[name], tables[name]
        if name != merged:
            check(name, "ROWS", counted(before, after))
            rest = [c for c in before.columns if c not in columns]
            bags = [table_digest(df, row_text(df, *rest) if rest else F.lit("")).select(F.struct("*").alias(n)) for df, n in ((before, "x"), (after, "y"))]
            check(name, "OTHER_COLUMNS", bags[0].crossJoin(bags[1]).select((F.col("x") == F.col("y")).alias("holds")))
        for column in columns:
            left = after.join(gone.withColumnRenamed("id", column), column, "left_semi").limit(1).agg(F.count(F.lit(1)).alias("n"))
            check(name, f"NO_OLD_IDS:{column}", left.select((F.col("n") == 0).alias("holds")))
    return Migration(tables, reduce(DataFrame.unionByName, checks))
