"""The retrieval rows of the documents: neighbours by hash order, rows that move once, small files."""

import hashlib
import random

import pytest

from weft.plans import audit, fixtures

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, folder, ids):
    rows = [(i, f"text {k} of {i}", "en", f"s{k % 3}", 9) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 60])
def test_negatives_are_the_next_rows_in_hash_order(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(fixtures, "partitions_for", lambda df: 7)
    monkeypatch.setattr(fixtures, "_ROW_BYTES", 200)
    rows = sorted(documents(spark, tmp_path, range(n)), key=lambda r: hashlib.sha256(str(r[0]).encode()).hexdigest())
    want = [(r[0], r[1], r[1], *(rows[(i + k) % n][1] for k in (1, 2, 3)), r[3], r[2]) for i, r in enumerate(rows)]
    got = fixtures.qa_rows(spark, str(tmp_path))
    assert got.columns == ["row_id", "query", "document", "negative1", "negative2", "negative3", "category", "language"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_negatives_of_repeated_and_null_ids(spark, tmp_path, monkeypatch):
    """Rows of one id come in any order, but each is followed by the others once."""
    monkeypatch.setattr(fixtures, "partitions_for", lambda df: 16)
    rnd = random.Random(2)
    rows = documents(spark, tmp_path, [None, None, 4, 4, 4, 4, 4, 4, *(rnd.randint(0, 9) for _ in range(40))])
    got = fixtures.qa_rows(spark, str(tmp_path)).collect()
    follows = {r.document: (r.negative1, r.negative2, r.negative3) for r in got}
    assert len(got) == len(follows) == len(rows)
    ring, at = [], rows[0][1]
    for _ in rows:
        ring.append(at)
        at = follows[at][0]
    assert at == ring[0] and len(set(ring)) == len(rows)
    assert all(follows[t] == tuple(ring[(i + k) % len(ring)] for k in (1, 2, 3)) for i, t in enumerate(ring))
    key = {r[1]: "" if r[0] is None else hashlib.sha256(str(r[0]).encode()).hexdigest() for r in rows}
    keys = [key[t] for t in ring]
    first = min(i for i, k in enumerate(keys) if k == "" and keys[i - 1] != "")
    assert keys[first:] + keys[:first] == sorted(keys)


def test_texts_are_moved_once(spark, tmp_path, capsys):
    documents(spark, tmp_path, range(30))
    fixtures.qa_rows(spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") == 1 and "SortMergeJoin" not in plan


def test_the_lines_of_integrity_checks_are_written_small(spark, tmp_path, monkeypatch):
    documents(spark, tmp_path, range(50))
    path = str(tmp_path / "lines")
    monkeypatch.setattr(audit.IO, "scratch_path", lambda spark, name: path)
    got = {r["check"]: r["count"] for r in audit.integrity_checks(spark, str(tmp_path)).collect()}
    assert (got["parse_errors"], got["missing_columns"], got["unique_candidates"]) == (2, 1, 50)
    parts = [p for p in (tmp_path / "lines").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.name.endswith(".gz") for p in parts)


def test_lengths_of_all_text_columns(spark, tmp_path):
    documents(spark, tmp_path, range(9))
    got = {r["field"]: (r.min_words, r.max_words, r.median_chars) for r in audit.length_summary(spark, str(tmp_path)).collect()}
    assert got == {c: (4, 4, 11.0) for c in ("query", "document", "negative1", "negative2", "negative3")}
