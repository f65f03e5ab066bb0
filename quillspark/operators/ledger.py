"""Documents with versions, issues with events, records of several kinds in one list, and edges that close a cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.guidance import page
from quillspark.operators.logs import latest
from quillspark.session import cut


def versions_of(documents: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Versions with the columns of their document; versions of no document are left out (see sets.dangling)."""
    own = [c for c in documents.columns if c != key and c in versions.columns]
    return versions.join(documents.drop(*own), key)


def current_versions(documents: DataFrame, versions: DataFrame, key: str, current: str, version: str) -> DataFrame:
    """Documents with their current version's columns; a document whose current version doesn't stand has nulls."""
    v = versions.select(F.col(key).alias("_k"), F.col(version).alias("_v"), *(c for c in versions.columns if c not in documents.columns and c != version))
    return documents.join(v, (F.col(key) == F.col("_k")) & (F.col(current) == F.col("_v")), "left").drop("_k", "_v")


def next_version_numbers(documents: DataFrame, versions: DataFrame, key: str, number: str) -> DataFrame:
    """Rows (key, next_no): 1 for a document without a version, else the highest number and one."""
    most = versions.groupBy(key).agg(F.max(number).alias("_n"))
    return documents.select(key).distinct().join(most, key, "left").select(key, (F.coalesce("_n", F.lit(0)) + 1).alias("next_no"))


def snapshot_page(entries: DataFrame, versions: DataFrame, documents: DataFrame, ordinal: str, version: str, key: str, after: int | None, size: int) -> DataFrame:
    """A page of a snapshot's entries after an ordinal with their version and document, and whether more follow.

    The page is cut out of the entries first, so the joins see no more than its rows.
    """
    rows = page(entries, [ordinal], None if after is None else (after,), size)
    return rows.join(versions, version).join(documents, key)


def issue_states(issues: DataFrame, events: DataFrame, key: str, order: str, state: str, default: str = "open") -> DataFrame:
    """Issues with the state of their last event (order of arrival), default where none came, and how many came."""
    last = latest(events, [key], order, [state]).select(key, F.col(state).alias("_state"))
    counts = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return issues.join(last, key, "left").join(counts, key, "left").withColumns({"state": F.coalesce("_state", F.lit(default)), "n_events": F.coalesce("_n", F.lit(0))}).drop("_state", "_n")


def one_list(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Rows (kind, columns) of several tables in one list; repeated rows stay."""
    out = None
    for kind, df in parts.items():
        rows = df.select(F.lit(kind).alias("kind"), *columns)
        out = rows if out is None else out.unionAll(rows)
    return out


def merged_page(parts: dict[str, DataFrame], columns: list[str], keys: list[str], cursor: tuple | None, size: int) -> DataFrame:
    """A page of several tables' rows in one order, see guidance.page; keys tell all rows apart."""
    return page(one_list(parts, columns), keys, cursor, size)


def ordered_union(*lists: Column) -> Column:
    """The values of several lists, each once, in order of first appearance; null lists are empty."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def unmapped(values: Column, aliases: dict[str, list[str]], known: list[str]) -> Column:
    """The values, each replaced by what it is an alias of, that are not known."""
    expanded = F.flatten(F.transform(values, lambda v: F.coalesce(*(F.when(v == a, F.array(*map(F.lit, to))) for a, to in aliases.items()), F.array(v))))
    return F.array_sort(F.array_except(expanded, F.array(*map(F.lit, known))))


def code_sets(df: DataFrame, key: str, codes: Column) -> DataFrame:
    """Rows (key, codes): the sorted different codes of all rows of a key; keys without a code have an empty list.

    codes is a list of few different values, so the set stays small; it is combined before the shuffle.
    """
    return df.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(codes)))).alias("codes"))


def within_lines(found: DataFrame, line: str, first: Column, last: Column) -> DataFrame:
    """The findings that stand in lines first to last, both included."""
    return found.where(F.col(line).between(first, last))


def offset_page(df: DataFrame, keys: list[str], recorded: str, as_of: str, start: int, size: int) -> DataFrame:
    """size rows from a place on, in order, of what had been recorded by an instant: later rows don't shift the pages."""
    return df.where(F.col(recorded) <= F.to_timestamp(F.lit(as_of))).orderBy(*keys).offset(start).limit(size)


def item_digest(df: DataFrame, without: list[str]) -> Column:
    """A digest of all columns but some (such as the time of retrieval), by name, nulls told from empty texts."""
    kept = sorted(c for c in df.columns if c not in without)
    return F.sha2(F.concat_ws("\1", *(F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))) for c in kept)), 256)


def relation_rules(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations (source_document_id, target_document_id, relation_type, effective_from) with the sorted rules they break.

    Both documents stand and belong to one series, no document relates to itself, the source is no older than its target
    (published_on), and the relation doesn't start before its source is effective.
    """
    from quillspark.operators.sets import violated

    d = lambda side: documents.select(F.col("document_id").alias(f"{side}_document_id"), F.col("series_id").alias(f"_{side}_series"), F.col("published_on").alias(f"_{side}_on"), F.col("effective_from").alias(f"_{side}_from"))
    joined = relations.join(d("source"), "source_document_id", "left").join(d("target"), "target_document_id", "left")
    there = F.col("_source_series").isNotNull() & F.col("_target_series").isNotNull()
    rules = violated({
        "document_missing": there, "other_series": ~there | (F.col("_source_series") == F.col("_target_series")), "to_itself": F.col("source_document_id") != F.col("target_document_id"),
        "source_older": ~there | F.coalesce(F.col("_source_on") >= F.col("_target_on"), F.lit(True)), "starts_early": ~there | F.coalesce(F.col("effective_from") >= F.col("_source_from"), F.lit(True)),
    })
    return joined.select(*relations.columns, rules.alias("rules"))


def closing_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The new edges (source, target) that close a cycle with the edges that stand: their target leads back to their source.

    From every new target the nodes that it reaches are followed, all new edges at a time, until no pair is new; lineage is cut each
    round in the shared folder. New edges are each tried alone. An edge to itself closes one. Null ends are ignored.
    """
    e = cut(edges.select(F.col("source").alias("_s"), F.col("target").alias("_t")).where("_s is not null and _t is not null").distinct())
    asked = cut(new.select("source", "target").where("source is not null and target is not null").distinct())
    seen = fresh = cut(asked.select(F.col("target").alias("_from"), F.col("target").alias("_at")).distinct())
    while not fresh.isEmpty():
        step = fresh.join(e, F.col("_at") == F.col("_s")).select("_from", F.col("_t").alias("_at")).distinct()
        fresh = cut(step.join(seen, ["_from", "_at"], "left_anti"))
        seen = cut(seen.unionByName(fresh))
    return asked.join(seen, (F.col("target") == F.col("_from")) & (F.col("source") == F.col("_at")), "left_semi")
