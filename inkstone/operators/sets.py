"""Set operations and sequential merges of rooms."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.operators.folds import fold_sorted
from inkstone.operators.ranking import full_rank

EVIDENCE = ["kind", "source", "title", "topic", "text"]


def evidence_union(parts: list[DataFrame]) -> DataFrame:
    """All candidate kinds in one shape; rows lacking title or text are dropped."""
    out = parts[0].select(*EVIDENCE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*EVIDENCE))
    return out.where("trim(coalesce(title, '')) <> '' and trim(coalesce(text, '')) <> ''")


def demoted_rest(inputs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """input minus kept."""
    return inputs.select(*keys).distinct().join(kept.select(*keys).distinct(), keys, "left_anti")


def keyed_replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Newer rows replace old rows of the same key, unseen keys are appended."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def strict_total(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of sums, null wherever any input is null."""
    return df.agg(*[F.when(F.count(F.col(c)) == F.count(F.lit(1)), F.sum(c)).alias(c) for c in cols])


def filter_listed(listed: DataFrame, inputs: DataFrame, keys: list[str], title: str, ord_: str) -> DataFrame:
    """Listed titles known to the input at their first place; unknown ones are flagged, not kept.

    (keys.., title, ord, known): a title listed twice keeps its first position.
    """
    first = listed.groupBy(*keys, title).agg(F.min(ord_).alias(ord_))
    return first.join(inputs.select(*keys, title).distinct().withColumn("known", F.lit(True)), [*keys, title], "left").withColumn(
        "known", F.coalesce("known", F.lit(False)))


def merge_plan(kept: DataFrame, min_kept: int, max_rooms: int) -> DataFrame:
    """(doc_id, idx, host, ord, new_id, absorbed): the room that every room of a document ends in.

    Input is one row per room (doc_id, idx, kept_n). Only neighbours join, so what is left of a document is a list of
    intervals of its rooms: members keep reading order and only the host has to be remembered. The smallest interval
    comes from a heap and its neighbours from links, n log n for n rooms.
    """
    def plan(key, rows):
        rooms = [r[1] for r in rows]
        end = len(rooms)
        size, host = [r[2] for r in rows], list(rooms)
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))  # heads of the neighbouring intervals
        small = [(n, i) for i, n in enumerate(size)]
        heapify(small)
        left = end
        while left > 1 and (left > max_rooms or small[0][0] < min_kept):
            n, i = heappop(small)
            if size[i] != n:  # has grown or gone since
                continue
            head = before[i] if before[i] >= 0 else i
            tail = after[head]
            if head == i:
                host[head] = host[tail]
            size[head], size[tail] = size[head] + size[tail], None
            after[head] = after[tail]
            if after[tail] < end:
                before[after[tail]] = head
            heappush(small, (size[head], head))
            left -= 1
            while left > 1 and size[small[0][1]] != small[0][0]:
                heappop(small)
        heads = [i for i in range(end) if size[i] is not None]
        return [(key[0], rooms[p], host[h], p - h, new) for new, h in enumerate(heads) for p in range(h, after[h])]

    out = fold_sorted(kept.select("doc_id", "idx", "kept_n"), ["doc_id"], ["idx"], plan, "doc_id long, idx int, host int, ord int, new_id int")
    return out.withColumn("absorbed", F.col("idx") != F.col("host"))


def absorb_rooms(rooms: DataFrame, sections: DataFrame, min_kept: int, max_rooms: int) -> DataFrame:
    """Members in their rooms after merging, re-ranked with the earlier room's members first."""
    n = rooms.groupBy("doc_id", F.col("section").alias("idx")).agg(F.count_if(F.col("status") == "kept").alias("kept_n"))
    sizes = sections.select("doc_id", "idx").join(n, ["doc_id", "idx"], "left").fillna(0, ["kept_n"])
    plan = merge_plan(sizes, min_kept, max_rooms)
    j = rooms.join(plan.withColumnRenamed("idx", "section"), ["doc_id", "section"])
    w = Window.partitionBy("doc_id", "new_id", "status").orderBy("ord", "rank")
    return j.select("doc_id", "new_id", "host", "section", "title", "status", F.row_number().over(w).alias("rank"))


def absorb_empty(rooms: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, kind, new_id, ord, idx, title, n): older rule, rooms without kept members join the next room that has some, else the previous.

    Rooms left are numbered anew. ``kept`` and ``demoted`` rows are members, a host's own demoted ones before those it
    takes over, in order of their rooms; an ``absorbed`` row names a room that went and counts its demoted members. A
    document without any kept member stays as it is.
    """
    n = rooms.groupBy("doc_id", F.col("section").alias("idx")).agg(
        F.count_if(F.col("status") == "kept").alias("kept_n"), F.count_if(F.col("status") == "demoted").alias("demoted_n"))
    s = sections.select("doc_id", "idx", "name").join(n, ["doc_id", "idx"], "left").fillna(0, ["kept_n", "demoted_n"])
    w = Window.partitionBy("doc_id").orderBy("idx")  # the rooms of one document
    live = F.when(F.col("kept_n") > 0, F.col("idx"))
    nxt = F.first(live, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    prv = F.last(live, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("host", F.coalesce(nxt, prv, F.col("idx")))
    stays = F.col("host") == F.col("idx")
    s = s.withColumn("own_id", F.sum(stays.cast("int")).over(w) - 1)
    s = s.withColumn("new_id", F.max(F.when(stays, F.col("own_id"))).over(Window.partitionBy("doc_id", "host")).cast("int"))
    member = rooms.select("doc_id", F.col("section").alias("idx"), "title", "status", "rank").join(s.select("doc_id", "idx", "host", "new_id"), ["doc_id", "idx"])
    rows = member.select("doc_id", F.col("status").alias("kind"), "new_id", "idx", "title", F.lit(None).cast("long").alias("n"), (~stays).alias("moved"), "rank").unionByName(
        s.where(~stays).select("doc_id", F.lit("absorbed").alias("kind"), "new_id", "idx", F.col("name").alias("title"), F.col("demoted_n").alias("n"), F.lit(True).alias("moved"), F.lit(0).alias("rank")))
    order = Window.partitionBy("doc_id", "new_id", "kind").orderBy("moved", "idx", "rank", "title")
    return rows.select("doc_id", "kind", "new_id", F.row_number().over(order).alias("ord"), "idx", "title", "n")


def frozen_input(entities: DataFrame, members: DataFrame, reports: DataFrame) -> DataFrame:
    """(kind, id, ord, title, type, n, detail): everything a frozen grouping task is given, as rows.

    ``entity`` rows are all entities with degree and description; ``community`` rows their reports with size and
    summary; ``member`` rows every member of every community in entity order; ``uncovered`` rows the titles no
    community has. entities(id, title, type, degree, description), members(community, id), reports(community, title, summary).
    """
    known = members.join(entities.select("id", "title"), "id")
    size = members.groupBy("community").agg(F.count("*").alias("n"))
    none = F.lit(None)
    rows = entities.select(F.lit("entity").alias("kind"), "id", none.cast("long").alias("ord"), "title", "type", F.col("degree").cast("long").alias("n"), F.col("description").alias("detail"))
    rows = rows.unionByName(reports.join(size, "community").select(
        F.lit("community").alias("kind"), F.col("community").alias("id"), none.cast("long").alias("ord"), "title", none.cast("string").alias("type"), "n", F.col("summary").alias("detail")))
    ranked = full_rank(known, ["community"], F.floor(F.col("id") / 100_000), ["id"], "ord")
    rows = rows.unionByName(ranked.select(F.lit("member").alias("kind"), F.col("community").alias("id"), "ord", "title", none.cast("string").alias("type"), none.cast("long").alias("n"), none.cast("string").alias("detail")))
    bare = entities.select("title").distinct().join(known.select("title").distinct(), "title", "left_anti")
    return rows.unionByName(bare.select(F.lit("uncovered").alias("kind"), none.cast("long").alias("id"), none.cast("long").alias("ord"), "title", none.cast("string").alias("type"),
                                        none.cast("long").alias("n"), none.cast("string").alias("detail")))


def room_spec(rooms: DataFrame, sections: DataFrame) -> DataFrame:
    """Rooms in the common shape, one row per room with counts and defaults; empty rooms included."""
    n = rooms.groupBy("doc_id", F.col("section").alias("idx")).agg(
        F.count_if(F.col("status") == "kept").alias("kept_n"), F.count_if(F.col("status") == "demoted").alias("demoted_n"))
    j = sections.join(n, ["doc_id", "idx"], "left").fillna(0, ["kept_n", "demoted_n"])
    return j.select(
        "doc_id", F.col("idx").alias("room_id"), F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("room "), F.col("idx").cast("string"))).alias("name"),
        "kept_n", "demoted_n", F.when(F.col("kept_n") == 0, "empty").otherwise("ok").alias("coherence_flag"),
        F.concat(F.lit("cluster_"), F.col("idx").cast("string")).alias("source_cluster"), "start_offset", "end_offset")


def keep_demote_apply(members: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Status of every member by membership in the kept set."""
    k = kept.select(*keys).distinct().withColumn("_k", F.lit(True))
    return members.join(k, keys, "left").withColumn("status", F.when(F.col("_k"), "kept").otherwise("demoted")).drop("_k")


def export_errors(rooms: DataFrame, spec: DataFrame, known: DataFrame, max_rooms: int) -> DataFrame:
    """(doc_id, error): room count, kept count, missing fields, unknown titles."""
    real = rooms.where("status = 'kept'").groupBy("doc_id", F.col("section").alias("room_id")).agg(F.count("*").alias("real_n"))
    count = spec.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > max_rooms).select(
        "doc_id", F.concat(F.lit("room_count "), F.col("n").cast("string")).alias("error"))
    kept = spec.join(real, ["doc_id", "room_id"], "left").where(F.col("kept_n") != F.coalesce("real_n", F.lit(0))).select(
        "doc_id", F.concat(F.lit("kept_count "), F.col("room_id").cast("string")).alias("error"))
    field = rooms.where("title is null or trim(title) = '' or pos is null").select("doc_id", F.lit("missing_field").alias("error"))
    unknown = rooms.join(known.select("doc_id", "title"), ["doc_id", "title"], "left_anti").select(
        "doc_id", F.concat(F.lit("unknown_title "), F.col("title")).alias("error"))
    return count.unionByName(kept).unionByName(field).unionByName(unknown)
