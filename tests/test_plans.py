"""Plan shapes: no cross join with a growing side, pruned scans, rank limits below the shuffle."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["entity_pages", "page_window_candidates", "entity_hits", "span_overlap", "section_asof", "candidate_score", "pair_jaccard", "match_collisions", "provenance"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["top_per_cluster", "majority_keep", "room_payload", "latest_sessions", "provenance"])
def test_rank_limit_is_partial(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["entity_positions", "mention_counts", "first_occurrence", "entity_pages", "entity_hits", "candidate_score", "chunk_spans"])
def test_texts_are_not_shuffled(spark, name):
    """No exchange below or above the scan of a text carries a text column."""
    for line in plan(QUERIES[name](spark, SF)).split("== Physical Plan ==")[-1].splitlines():
        if "Exchange" in line and "Project" not in line:
            assert not re.search(r"hashpartitioning\([^)]*\btext#", line)


@pytest.mark.parametrize("name", ["match_cascade", "match_collisions", "caption_box_match", "local_context", "vector_topk", "orphan_home", "cluster_quality", "provenance_reports", "frozen_input", "absorb_empty"])
def test_no_product_of_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and not re.search(r"BroadcastNestedLoopJoin (?!BuildRight, Inner\b)", text)


def test_scan_is_pruned_and_filtered(spark):
    text = plan(QUERIES["entity_hits"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(role,user\)", text)
    reads = re.findall(r"ReadSchema: (struct<[^\n]*)", plan(QUERIES["usage_by_model"](spark, SF)))
    assert reads and all("value" not in r and "ts" not in r for r in reads)


def test_no_local_checkpoint_in_sources():
    from pathlib import Path

    for p in (Path(__file__).resolve().parents[1] / "inkstone").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text()


@pytest.mark.parametrize("name", ["match_score", "match_cascade", "page_window_candidates"])
def test_pairs_of_figure_and_entity_are_not_shuffled(spark, name):
    assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, (row#\d+, )?title#", plan(QUERIES[name](spark, SF)).split("== Physical Plan ==")[-1])


def test_edges_and_entities_are_dealt_by_document_once(spark):
    from inkstone.plans import views as V
    from inkstone.plans.registry import Tables

    t = Tables(spark, SF)
    for df in (V.build_edges(t), V.build_entities(t)):
        assert re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df).split("== Physical Plan ==")[-1]) and not re.search(
            r"Exchange hashpartitioning\(doc_id#\d+L?, [a-z_]+#", plan(df).split("== Physical Plan ==")[-1])


def test_positions_and_sections_are_dealt_by_document_once(spark):
    from inkstone.plans import positions as PP
    from inkstone.plans.registry import Tables

    t = Tables(spark, SF)
    text = plan(PP.build_members(t)).split("== Physical Plan ==")[-1]
    assert "Join" not in text and set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", text))) == {"doc_id"}
    assert "Join" not in plan(PP.assigned(t)) and "Join" not in plan(PP.ordered(t))


def test_words_of_a_chunk_are_found_once(spark):
    from inkstone.plans import views as V
    from inkstone.plans.registry import Tables

    text = plan(V.build_mentions(Tables(spark, SF))).split("== Physical Plan ==")[-1]
    assert not re.search(r"Filter [^\n]*regexp_extract_all\(text", text.split("Scan parquet")[0])
