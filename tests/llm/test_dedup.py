"""Duplicate removal against brute force, and on awkward rows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from helpers import deduped_lines, frame, repeated_bytes, similar_groups
from pyspark.sql import functions as F

from crawlsight.llm import exact_dedup, line_dedup, minhash_dedup, shingles, suffix_dedup, workspace


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


def edited(rng, text, edits):
    parts = text.split(" ")
    for _ in range(edits):
        parts[rng.randrange(len(parts))] = words(rng, 1)
    return " ".join(parts)


@pytest.fixture(scope="module")
def awkward():
    """Copies, near copies of several strengths, shared passages, empty, short, repetitive and non-ASCII texts."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 30)
    rows = [(1, base), (7, base), (3, base.upper()), (9, base.replace(" ", "  \t"))]
    rows += [(20 + i, edited(rng, base, i % 7)) for i in range(40)]
    rows += [(100 + i, words(rng, 15) + "\n" + passage + "\n" + words(rng, 20)) for i in range(30)]
    rows += [(200, ""), (201, None), (202, "  \n "), (203, "a b"), (204, "A  b"), (205, "x" * 49), (206, "x" * 50), (207, "x" * 400)]
    rows += [(208, "ü" * 60), (209, "a" + "ü" * 60 + "\0\0"), (210, "Und " * 200), (211, "Und " * 190), (212, "\n\n\na b\n"), (213, passage * 40)]
    rows += [(214, "\0" * 60), (215, "\0" * 55 + "z"), (216, "tail\n"), (217, "\ntail")]
    rng.shuffle(rows)
    return rows


def by_id(found, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in found.collect()}


def test_repeated_passages(spark, awkward):
    for parts in (1, 9):
        got = suffix_dedup.removals(frame(spark, awkward).repartition(parts))
        assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeated_bytes(awkward)
        for row in got.where("n_removed > 0").collect():
            assert sum(s["length"] for s in row.spans) == row.n_removed


def test_repeated_passages_of_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(7)
    want = repeated_bytes([(r.doc_id, r.text) for r in docs.collect()])
    assert by_id(suffix_dedup.removals(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_cover_meets_every_pair():
    differences = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert differences == set(range(suffix_dedup.PERIOD))


def test_cover_ranks_are_in_order_of_bytes():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (200, suffix_dedup.CONTEXT + 2)).astype(np.uint8)
    rows[100:] = rows[:100]
    rows[:, suffix_dedup.CONTEXT], rows[:, suffix_dedup.CONTEXT + 1] = 5, 20
    ranks = suffix_dedup._cover_ranks(rows)
    found = sorted((rows[i, x : x + suffix_dedup.SAMPLE].tobytes(), ranks[i, x]) for i, x in zip(*np.nonzero(ranks)))
    assert all((x - 4) % suffix_dedup.PERIOD in suffix_dedup.COVER for _, x in zip(*np.nonzero(ranks)))
    assert len(found) > 1000 and [b for _, b in found] == sorted(b for _, b in found)
    assert len({a for a, _ in found}) == len({b for _, b in found}) == max(b for _, b in found)


def test_ties_are_resolved_by_cover_ranks(monkeypatch):
    """Suffixes that differ only below a sample are told apart by its rank."""
    rng = np.random.default_rng(4)
    base = rng.integers(97, 123, suffix_dedup.CONTEXT).astype(np.uint8)
    rows = np.zeros((40, suffix_dedup.CONTEXT + 2), np.uint8)
    rows[:, : suffix_dedup.CONTEXT] = base
    rows[:, suffix_dedup.CONTEXT], rows[:, suffix_dedup.CONTEXT + 1] = 26, suffix_dedup.CHOICES
    rows[20:, 45:47] += 1
    first, all_ = np.arange(100, 140), np.arange(40)

    def sort():
        best = np.full((40, suffix_dedup.CHOICES), 10**9)
        suffix_dedup._sort_suffixes(rows, first, best, all_)
        want = np.where((np.arange(40) < 20)[:, None], 100, 120)
        return best[:, : suffix_dedup.CHOICES - 5] - want[:, :1]

    with_ranks = sort()[:, :26]
    assert (with_ranks == 0).all()
    real = suffix_dedup._cover_ranks
    monkeypatch.setattr(suffix_dedup, "_cover_ranks", lambda d: (real(d) > 0).astype(np.uint32))
    assert (sort()[:, :26] != 0).any()


def test_long_repeats(spark):
    """A repeat of 5 MB, whole and in part, in texts of several chunk sizes."""
    rng = np.random.default_rng(5)
    text = lambda n: rng.integers(33, 127, n).astype(np.uint8).tobytes().decode()
    long, a, b, c = text(5_000_000), text(1000), text(777), text(49)
    rows = [(1, long), (2, a + long + b), (3, long[1000:4_000_000] + c + long[:49] + c), (4, long[70:119]), (5, long[70:120])]
    got = by_id(suffix_dedup.removals(frame(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = [(long, 0), (a + b, 1), (c + long[:49] + c, 1), (long[70:119], 0), ("", 1)]
    assert got == {d: (len(t), len(t) - len(k), n, sha(k)) for (d, t), (k, n) in zip(rows, kept)}


def test_small_chunks(spark, awkward, monkeypatch):
    from crawlsight.llm import chunks

    monkeypatch.setattr(chunks, "CHUNK_BYTES", 700)
    monkeypatch.setattr(chunks, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(chunks, "BROADCAST_BYTES", 0)
    docs = frame(spark, awkward).repartition(3)
    assert by_id(suffix_dedup.removals(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeated_bytes(awkward)
    assert by_id(line_dedup.removed_lines(docs), "n_lines", "n_removed", "kept_sha256") == deduped_lines(awkward)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_groups(spark, awkward, percent):
    got = minhash_dedup.near_groups(frame(spark, awkward).repartition(6), percent)
    assert by_id(got, "n_shingles", "component_id", "kept") == similar_groups(awkward, percent)


def test_near_groups_of_table(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    want = similar_groups([(r.doc_id, r.text) for r in docs.collect()], 85)
    assert by_id(minhash_dedup.near_groups(docs), "n_shingles", "component_id", "kept") == want


def test_near_groups_of_a_crowd(spark):
    """Many edits of one text: most are linked with the text or with nothing."""
    rng = random.Random(3)
    base = words(rng, 150)
    rows = [(i, edited(rng, base, rng.randint(0, 12))) for i in range(300)]
    rows += [(1000 + i, edited(rng, rows[i][1], 1)) for i in range(60)]
    got = minhash_dedup.near_groups(frame(spark, rows, extra=False))
    assert by_id(got, "n_shingles", "component_id", "kept") == similar_groups(rows, 85)
    left = minhash_dedup.drop_near_copies(frame(spark, rows))
    assert {r.doc_id for r in left.collect()} == {d for d, v in similar_groups(rows, 85).items() if v[2]}
    assert left.columns == frame(spark, rows).columns


def test_near_groups_of_a_crowd_without_its_origin(spark):
    """Copies too far from the origin to be linked with it, some of which are linked with each other."""
    rng = random.Random(11)
    base = words(rng, 200)
    rows = [(0, base)] + [(1 + i, edited(rng, base, 9)) for i in range(150)]
    rows += [(500 + i, edited(rng, rows[1 + i][1], rng.randint(1, 5))) for i in range(60)]
    for percent in (80, 85):
        got = minhash_dedup.near_groups(frame(spark, rows, extra=False), percent)
        want = similar_groups(rows, percent)
        assert by_id(got, "n_shingles", "component_id", "kept") == want
        assert 20 < len({v[1] for v in want.values()}) < 200


def test_index_guarantee():
    """Signatures that differ in as many values as the index allows share a key, wherever they differ."""
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, minhash_dedup.COORDINATES)).astype(np.uint16)
    b = a.copy()
    allowed = minhash_dedup.BLOCKS * (minhash_dedup.ERRORS + 1) - 1
    for row in b:
        row[rng.choice(minhash_dedup.COORDINATES, allowed, replace=False)] += 1
    for x, y in zip(minhash_dedup.index_keys(a), minhash_dedup.index_keys(b)):
        assert set(x.tolist()) & set(y.tolist())


def test_lines(spark, awkward):
    got = line_dedup.removed_lines(frame(spark, awkward).repartition(5))
    assert by_id(got, "n_lines", "n_removed", "kept_sha256") == deduped_lines(awkward)


def test_lines_with_edits(spark):
    rng = random.Random(9)
    lines = [words(rng, rng.randint(20, 60)) for _ in range(12)]
    rows = []
    for i in range(60):
        own = [edited(rng, rng.choice(lines), rng.randint(0, 3)) for _ in range(4)]
        rows.append((i, "\n".join(own + [words(rng, 3), ""])))
    got = line_dedup.removed_lines(frame(spark, rows))
    assert by_id(got, "n_lines", "n_removed", "kept_sha256") == deduped_lines(rows)


@pytest.mark.parametrize("percent", [20, 87, 90, 95])
def test_lines_and_their_beginnings(spark, percent):
    rng, rows = random.Random(percent), []
    for n in range(60):
        line = words(rng, 14 if n % 2 else 24)
        rows += [(2 * n, line), (2 * n + 1, line.rsplit(" ", 1)[0])]
    got = line_dedup.removed_lines(frame(spark, rows), percent)
    assert by_id(got, "n_lines", "n_removed", "kept_sha256") == deduped_lines(rows, percent)


def test_longer_prefixes_lose_nothing():
    sizes = np.arange(1, 400)
    for percent in range(1, 101):
        more = line_dedup._longer(sizes, percent)
        first = line_dedup.prefix_sizes(sizes, percent, more)
        n, m = np.meshgrid(sizes, sizes, indexing="ij")
        common = -(-percent * (n + m) // (100 + percent))
        own, other = first[n - 1] - (n - common), first[m - 1] - (m - common)
        shared = np.minimum(common, np.minimum(own, other))
        assert ((shared > more[n - 1]) | (common > np.minimum(n, m))).all(), percent


def test_words_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"abcABC\xc3 \n\t", np.uint8), 5000)
    data[1000:1400] = 97
    starts = np.unique(np.concatenate(([0, 5000], rng.integers(0, 5000, 300))))
    whole = shingles.words(data, starts, data == 65)
    for block in (1, 7, 64, 1000):
        monkeypatch.setattr(shingles, "_BLOCK", block)
        got = shingles.words(data, starts, data == 65)
        assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all()
    assert len(shingles.words(data[:0], starts[:1])[0]) == 0


def test_sets_of_very_many_texts():
    counts = np.ones((1 << 20) + 4, np.int64)
    word = np.random.default_rng(9).integers(1 << 63, size=len(counts)).astype(np.uint64)
    value, held = shingles.shingle_sets(word, counts)
    assert (held == 1).all() and (value == shingles.shingles(word, counts)[0]).all()


def test_text_of_very_many_lines(spark):
    lines = [""] * ((1 << 20) + 8)
    for i in range(4):
        lines[i] = words(random.Random(i), 12)
        lines[(1 << 20) + i] = words(random.Random(10 + i), 12)
    lines[(1 << 20) + 5] = lines[1]
    other = [lines[(1 << 20) + 2], "a line of its own", lines[3]]
    found = line_dedup.removed_lines(frame(spark, [(1, "\n".join(lines)), (2, "\n".join(other))], extra=False))
    got = {r.doc_id: (r.n_lines, r.removed_lines) for r in found.collect()}
    assert got == {1: (len(lines), [(1 << 20) + 5]), 2: (3, [0, 2])}


def test_exact_groups(spark, awkward):
    import re

    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in awkward}
    groups = {}
    for d, t in sorted(norm.items()):
        groups.setdefault(t, []).append(d)
    want = {d: (groups[t][0], len(groups[t]), groups[t][0] == d, hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items()}
    for bucket_rows in (1, 50_000):
        got = exact_dedup.exact_groups(frame(spark, awkward), bucket_rows)
        assert by_id(got, "keep_id", "group_size", "kept", "text_sha256") == want
    left = exact_dedup.drop_copies(frame(spark, awkward))
    assert {r.doc_id for r in left.collect()} == {d for d, v in want.items() if v[2]}
    assert left.columns == frame(spark, awkward).columns


def test_directory_splits(spark):
    entries = spark.range(2000).selectExpr("xxhash64(id) AS key")
    limit = exact_dedup.depth_limit(2000, 100)
    cells = {r.cell: (r.depth, r.bucket) for r in exact_dedup.directory(entries, 100, limit).collect()}
    depths = {d for d, _ in cells.values()}
    assert 4 <= min(depths) and max(depths) <= 8
    assert all(bucket == cell >> limit - depth for cell, (depth, bucket) in cells.items())
    held = collections.Counter()
    for r in entries.collect():
        held[cells[(r.key % 2**64) >> 64 - limit]] += 1
    assert max(held.values()) <= 100
    assert {r.depth for r in exact_dedup.directory(entries, 5000, exact_dedup.depth_limit(2000, 5000)).collect()} == {0}


def test_directory_has_no_cap():
    assert exact_dedup.depth_limit(10**12, 1) >= 40 and exact_dedup.depth_limit(0, 50_000) == exact_dedup.ROOM


def test_index_by_key_range(spark):
    digests = spark.range(3000).selectExpr("id AS doc_id", "xxhash64(id % 1000) AS key")
    space = workspace.Workspace(spark, "test")
    index = exact_dedup.build_index(digests, 20, space).withColumn("part", F.spark_partition_id()).collect()
    assert len(index) == 1000 and all(r.n == 3 and r.low <= (r.key % 2**64) >> 1 for r in index)
    lows = collections.defaultdict(list)
    for r in index:
        lows[r.low].append((r.key % 2**64) >> 1)
    edges = sorted(lows)
    assert len(edges) > 50 and all(max(lows[a]) < b for a, b in zip(edges, edges[1:])) and max(map(len, lows.values())) <= 20


def test_chains_compare_bytes(spark):
    """Records of one key: the same text in several records, and different texts whose hashes collide."""
    rows = [(0, 5, "a", 7, 2), (0, 5, "b", 3, 1), (0, 5, "a", 4, 10), (0, 5, "a ", None, 1), (0, 9, "a", 8, 1), (0, 5, "b", None, 4)]
    records = spark.createDataFrame(rows, "low long, key long, norm string, first long, n long")
    got = exact_dedup.resolve_chains(records, 3).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(r.key, r.sha, r.keep_id, r.group_size) for r in got} == {
        (5, digest("a"), 4, 12),
        (5, digest("b"), 3, 5),
        (5, digest("a "), None, 1),
        (9, digest("a"), 8, 1),
    }


def test_copies_with_colliding_hashes(spark, monkeypatch):
    """With a hash of one bit all texts share two chains."""
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100, None), (101, ""), (None, "text 3")]
    want = by_id(exact_dedup.exact_groups(frame(spark, rows)), "keep_id", "group_size", "kept", "text_sha256")
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2)) if c == ("norm",) else real(*c))
    got = by_id(exact_dedup.exact_groups(frame(spark, rows)), "keep_id", "group_size", "kept", "text_sha256")
    assert got == want and got[3][:2] == (3, 10)


def test_very_long_texts(spark):
    long = "long text " * 700_000
    rows = [(1, long), (2, long + "x"), (3, long.replace(" ", "\n")), (4, "\t" * 3_000_000), (5, " ")]
    got = by_id(exact_dedup.exact_groups(frame(spark, rows)), "keep_id", "group_size")
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 2), 5: (4, 2)}


CLASHING = "doc_id long, text string, source string, _sha string, gone_id long, gone_sha string, sha string, place int, _id long, _copy int, _times int, `a b` map<string,int>"


def clashing(spark):
    rows = [(1, "a b", "s", "x", 7, "y", "z", 3, 9, 4, 5, {"k": 1}), (2, "a  b", "s", "x", 7, "y", "z", 3, 9, 4, 5, None), (2, "a  b", "s", "w", 7, "y", "z", 3, 9, 4, 5, None)]
    rows += [(None, "c", None, None, None, None, None, None, None, None, None, None)] * 2 + [(5, None, "s", "v", 1, "y", "z", 3, 9, 4, 5, {})]
    return spark.createDataFrame(rows, CLASHING), rows


def test_drop_copies_with_clashing_names(spark):
    docs, rows = clashing(spark)
    for parts in (1, 5):
        left = exact_dedup.drop_copies(docs.repartition(parts))
        assert left.columns == docs.columns
        found = left.collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 1), (False, 5), (True, 0)]
        assert {str(r) for r in found} <= {str(r) for r in docs.collect()}
    twice = spark.createDataFrame([(2, "t", "x"), (2, "t", "w"), (3, "t", "q")], "doc_id long, text string, _sha string")
    first = exact_dedup.drop_copies(twice).collect()
    assert first == exact_dedup.drop_copies(twice.repartition(3)).collect() and len(first) == 1 and first[0].doc_id == 2


def test_hot_text(spark):
    """More copies of one text than the share that makes it hot."""
    rows = [(i, "same") for i in range(3000)] + [(i, str(i)) for i in range(3000, 6000)]
    got = exact_dedup.exact_groups(frame(spark, rows, extra=False))
    assert got.where("keep_id = 0 AND group_size = 3000").count() == 3000 and got.where("kept").count() == 3001


REPEATED = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (None, None)]


def test_repeated_rows_and_missing_ids(spark):
    docs = frame(spark, REPEATED)
    found = exact_dedup.exact_groups(docs)
    assert found.count() == 4 and found.where("keep_id = 1 AND group_size = 3").count() == 3
    assert exact_dedup.drop_copies(docs).count() == 2
    assert suffix_dedup.removals(docs).count() == 4
    near = minhash_dedup.near_groups(docs)
    assert near.count() == 4 and near.where("doc_id IS NULL AND kept").count() == 2
    assert line_dedup.removed_lines(docs).where("doc_id IS NULL").agg({"n_removed": "sum"}).first()[0] == 1


def test_one_id_with_two_texts(spark):
    rows = [(5, "a b c d e f g"), (5, "h i j k l m n"), (6, "h i j k l m n"), (2, "a b c d e f g")]
    got = minhash_dedup.near_groups(frame(spark, rows))
    assert {r.component_id for r in got.collect()} == {2}


def test_empty_tables(spark):
    none = frame(spark, REPEATED).where("false")
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert suffix_dedup.removals(none).count() == 0
    assert minhash_dedup.near_groups(none).count() == 0 and minhash_dedup.drop_near_copies(none).count() == 0
    assert line_dedup.removed_lines(none).count() == 0
