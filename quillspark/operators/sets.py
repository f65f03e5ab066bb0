"""Set operations and reconciliation: differences, tree synchronisation, manifests, integrity, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.history import running


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, side, n) of keys that only one side has (only_left, only_right) or has in another number (unequal)."""
    left, right = (x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) for x in (a, b))
    same = None
    for k in keys:
        same = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) if same is None else same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.alias("l").join(right.alias("r"), same, "full_outer")
    side = F.when(F.col("r.n").isNull(), "only_left").when(F.col("l.n").isNull(), "only_right").when(F.col("l.n") != F.col("r.n"), "unequal")
    return joined.select(*(F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys), side.alias("side"), F.coalesce("l.n", "r.n").alias("n")).where("side is not null")


def group_digests(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows (group, n, digest): a digest of a group's rows that doesn't depend on their order.

    It is the sum and the exclusive or of a 64-bit hash of each row, combined before the shuffle; no group is collected.
    """
    h = F.xxhash64(*columns)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 40)))), 256).alias("digest"),
    )


def tree_changes(known: DataFrame, found: DataFrame, key: str, content: str) -> DataFrame:
    """Rows (key, action): insert, new_version, unchanged or tombstone, from what is known and what was found."""
    k, f = known.select(F.col(key).alias("_k"), F.col(content).alias("_kc")), found.select(F.col(key).alias("_f"), F.col(content).alias("_fc"))
    joined = k.join(f, F.col("_k").eqNullSafe(F.col("_f")), "full_outer").withColumn("_in_k", F.col("_k").isNotNull()).withColumn("_in_f", F.col("_f").isNotNull())
    action = F.when(~F.col("_in_k"), "insert").when(~F.col("_in_f"), "tombstone").when(F.col("_kc").eqNullSafe(F.col("_fc")), "unchanged").otherwise("new_version")
    return joined.select(F.coalesce("_k", "_f").alias(key), action.alias("action"))


def manifest_status(manifest: DataFrame, files: DataFrame, key: str, path: str, digest: str) -> DataFrame:
    """Rows (key, status) of a manifest held against what stands there: ok, path_changed, modified or unsafe_or_missing."""
    m = manifest.select(key, F.col(path).alias("_mp"), F.col(digest).alias("_md"))
    f = files.select(key, F.col(path).alias("_fp"), F.col(digest).alias("_fd"))
    status = F.when(F.col("_fd").isNull(), "unsafe_or_missing").when(F.col("_md") != F.col("_fd"), "modified").when(F.col("_mp") != F.col("_fp"), "path_changed").otherwise("ok")
    return m.join(f, key, "left").select(key, status.alias("status"))


def dangling(child: DataFrame, foreign: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """One row (link, n_rows, n_dangling): how many rows of a child point to no parent. A null pointer points to none but isn't counted."""
    keys = parent.select(F.col(key).alias("_p")).distinct()
    joined = child.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("_f")).agg(F.count(F.lit(1)).alias("n")).join(keys, F.col("_f") == F.col("_p"), "left")
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("n"))), F.lit(0)).alias("n_dangling")).select(F.lit(name).alias("link"), "n_rows", "n_dangling")


def prefix_breaks(base: DataFrame, current: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Rows (order) of a base that a later state doesn't repeat at the same place with the same content."""
    digest = lambda df, name: df.select(F.col(order).alias(f"_{name}"), F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns)), 256).alias(f"_d{name}"))
    joined = digest(base, "b").join(digest(current, "c"), F.col("_b") == F.col("_c"), "left")
    return joined.where(~F.col("_db").eqNullSafe(F.col("_dc"))).select(F.col("_b").alias(order))


def ordinals(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with ordinal, from 0 in order within each group, numbered in two levels (see history.running)."""
    return running(df, group, order, F.lit(1), "ordinal").withColumn("ordinal", F.col("ordinal") - 1)


def snapshot_check(entries: DataFrame, snapshots: DataFrame, key: str, size: str) -> DataFrame:
    """Rows (key, complete): whether a snapshot's entries are numbered 0 to count - 1 and sum up to what it states.

    snapshots has key, source_count, total_bytes; a snapshot without entries is complete when it states 0 and 0.
    """
    sums = entries.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("ordinal").alias("_d"), F.min("ordinal").alias("_lo"), F.max("ordinal").alias("_hi"), F.sum(size).alias("_s"))
    joined = snapshots.join(sums, F.col(key) == F.col("_k"), "left")
    whole = (F.col("_n") == F.col("source_count")) & (F.col("_d") == F.col("_n")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("_n") - 1) & (F.col("_s") == F.col("total_bytes"))
    return joined.select(key, F.when(F.col("_n").isNull(), (F.col("source_count") == 0) & (F.col("total_bytes") == 0)).otherwise(F.coalesce(whole, F.lit(False))).alias("complete"))


def first_appearances(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows (key, order): where each key stands first; keys in that order are the list without repeats."""
    place = F.struct(*order)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias("_p")).select(key, *(F.col("_p")[c].alias(c) for c in order))


def term_candidates(terms: DataFrame, term: str, catalog: DataFrame, key: str, names: Column) -> DataFrame:
    """Rows (term, n, keys) of distinct terms: the catalogue keys that have a name equal to it but for case and blanks.

    Ambiguous terms keep all their keys, in order; unknown ones have none.
    """
    folded = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    known = catalog.select(F.col(key).alias("_key"), F.explode(names).alias("_n")).where("_n is not null").select("_key", folded(F.col("_n")).alias("_f")).distinct()
    asked = terms.select(F.col(term)).where(F.col(term).isNotNull()).distinct().withColumn("_t", folded(F.col(term)))
    found = asked.join(known, F.col("_t") == F.col("_f"), "left").groupBy(term).agg(F.array_sort(F.collect_set("_key")).alias("keys"))
    return found.select(term, F.size("keys").alias("n"), "keys")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, class_id, copies): one for each text; class_id is the smallest key of the texts that are the same.

    Texts are compared by length and SHA-256. Only digests are shuffled, and the classes are aggregated before they are
    joined back, so a class with a third of all texts is no group of one task. Null texts are in no class.
    """
    digests = df.where(F.col(text).isNotNull()).select(key, F.octet_length(text).alias("_n"), F.sha2(F.col(text), 256).alias("_d"))
    classes = digests.groupBy("_n", "_d").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return digests.join(classes, ["_n", "_d"]).select(key, "class_id", "copies")


def violated(rules: dict[str, Column]) -> Column:
    """The sorted names of the rules that a row breaks; a rule whose condition is null is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(rules.items()))))
