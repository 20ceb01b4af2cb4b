"""The subpackage's queries against their SQL, and the pipeline stage by stage."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import MEDIUM, SMALL
from helpers import similar_groups, slow_mix, slow_score
from oracle import check
from tokenizers import Tokenizer

import corpus_pipeline
from crawlsight.llm import quality
from crawlsight.llm.oracles import ORACLE_SQL
from crawlsight.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name], MEDIUM)


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def packed_once_per_copy(rows, pieces, length=1024):
    """Every id of every copy lies in one piece, and pieces fill their sequences without gaps."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    copies, held = collections.Counter(rows), {}
    for doc_id, text in copies:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        held[doc_id] = ids, np.zeros(len(ids), int)
    sequences = collections.defaultdict(list)
    for p in pieces:
        ids, seen = held[p.doc_id]
        body = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
        assert p.doc_tokens == len(ids) and zlib.crc32(body) == p.ids_crc32 and bytes(p.ids) == body
        seen[p.start : p.start + p.length] += 1
        sequences[p.sequence_id].append((p.offset, p.length))
    for (doc_id, _), n in copies.items():
        assert (held[doc_id][1] == n).all()
    for parts in sequences.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == length or ends[-1] & (ends[-1] - 1) == 0)


def test_stages_against_brute_force(spark):
    """Each stage, on what its predecessor keeps, against a slow version that shares no code with it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, docs
    table, bias = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet").where(~quality.held_out()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.collect()
        kept = stage(spark, kept, SMALL).cache()
        after = kept.collect()
        assert kept.columns == columns, name
        assert {str(r) for r in after} <= {str(r) for r in before}, name
        got = collections.Counter(r.doc_id for r in after)
        if name == "quality":
            scores = {r.doc_id: slow_score((r.text or "").encode(), table, bias) for r in before}
            assert all(got[d] == (s >= 0.7) for d, s in scores.items() if abs(s - 0.7) > 1e-5) and 0 < len(got) < len(before)
        if name == "exact dedup":
            first = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
            assert got == collections.Counter(first.values())
        if name == "near dedup":
            groups = similar_groups([(r.doc_id, r.text) for r in before], 80)
            assert got == collections.Counter(d for d, v in groups.items() if v[2])
        if name == "mixing":
            taken = slow_mix([(r.doc_id, r.text, r.source) for r in before])
            want = {d: int(t / size + 0.5) for d, size, t in taken if size}
            assert got == collections.Counter({d: n for d, n in want.items() if n})
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    packed_once_per_copy([(r.doc_id, r.text) for r in kept.collect()], pieces.collect())


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, empty and repeated rows, ties, a very long text, names that the operators use, and no rows."""
    long = "words of a very long text that repeats itself " * 20_000
    rows = [(1, "a b c d e f g", "en", "s", 3), (1, "a b c d e f g", "en", "s", 3), (2, "a b c  d e f g", None, None, None), (3, None, "en", "s", 3)]
    rows += [(4, "", None, "s", 0), (None, "x y z " * 40, "fr", None, 7), (None, None, None, None, None), (5, long, "en", "s", 9), (6, long + "end", "de", "t", 9)]
    rows += [(7 + i, f"a text like some others with number {i % 3} in it", "en", "t", 1) for i in range(9)]
    extra = ("score", "gone", "gone_id", "sha", "_sha", "row", "copy", "_copy", "_id", "times", "own", "place", "digest", "key", "chunk", "body", "norm")
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in extra)
    docs = spark.createDataFrame([(*r, *[i] * len(extra)) for i, r in enumerate(rows)], names)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), SMALL)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns), name
        found = stage(spark, docs, SMALL)
        assert sorted(map(str, found.collect())) == sorted(map(str, stage(spark, docs.repartition(5), SMALL).collect())) or name == "packing", name
        if name != "packing":
            assert found.columns == docs.columns and {str(r) for r in found.collect()} <= {str(r) for r in docs.collect()}, name
    once = [r.doc_id for r in stages["exact dedup"](spark, docs, SMALL).collect()]
    assert sorted(once, key=str) == sorted([1, 3, None, 5, 6, 7, 8, 9], key=str)
    near = [r.doc_id for r in stages["near dedup"](spark, docs, SMALL).collect()]
    assert sorted(near, key=str) == sorted([1, 1, 3, 4, None, None, 5, *range(7, 10)], key=str)
    pieces = stages["packing"](spark, docs.where("doc_id <> 1"), SMALL).collect()
    packed_once_per_copy([(r[0], r[1]) for r in rows if r[0] not in (None, 1)], pieces)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100
