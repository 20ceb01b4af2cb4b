"""Quality, chat, packing, mixing, scoring and search."""

import collections
import hashlib
import inspect
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import MEDIUM, SMALL
from helpers import WORD, frame, lowered, slow_mix, slow_score, water_filled
from tokenizers import Tokenizer

from crawlsight.llm import chat, chunks, line_dedup, lm_scoring, minhash_dedup, mixing, packing, quality, suffix_dedup, topk
from crawlsight.llm.chunks import unpack
from crawlsight.llm.queries import QUERIES


# --- quality -----------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    found = QUERIES["op2_quality"](spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) > 60
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_quality_of_awkward_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "   "), (4, "word " * 60_000), (5, "Zß\0"), (5, "Zß\0"), (None, "x")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    scored = quality.score(docs, model)
    assert scored.count() == 7 and {round(r.score, 6) for r in scored.collect()} == {0.5}
    assert scored.columns == [c for c in docs.columns if c != "text"] + ["score"]
    one = spark.createDataFrame([(1, 1), (4, 1), (4, None), (9, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, one)).where("score > 0.5").count() == 7
    assert quality.score(docs.where("false"), model).count() == 0
    assert quality.keep_good(docs, one).columns == docs.columns


def test_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    table = rng.normal(size=quality.BUCKETS).astype(np.float32)
    texts = [b"Some words here", b"", b"a", "Ünd &&& x".encode(), b"SHOUT!! SHOUT!!"]
    alone = [quality.score_texts([t], table, 0.1)[0] for t in texts]
    assert quality.score_texts(texts, table, 0.1) == pytest.approx(alone)


def test_scores_against_a_slow_scorer(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    table, bias = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = [(r.text or "").encode() for r in docs.collect()]
    texts += [b"", b" ", b"a", b"ab", b"x x x x y x", "Ünd &&& ÄÖ 12".encode(), b"SHOUT!! SHOUT!!\n\x0bx\0", b"\t word", b"word " * 3000]
    want = [slow_score(t, table, bias) for t in texts]
    assert max(want) - min(want) > 0.5
    assert quality.score_texts(texts, table, bias) == pytest.approx(want, abs=1e-5)


def test_training_sample_is_bounded(spark, tmp_path, monkeypatch):
    rows = [(i, "good words here " * 50 if i % 2 else "BAD!! " * 100) for i in range(40)] + [(100, "long " * 100_000)]
    docs = spark.createDataFrame([(*r, "x", 0.1) for r in rows], "doc_id long, text string, score string, _score double")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    real, folder = quality.Model.fit, f"{tmp_path}/seen"

    def spied(self, texts, known):
        with open(folder, "w") as out:
            out.write(" ".join(str(len(t)) for t in texts))
        return real(self, texts, known)

    monkeypatch.setattr(quality.Model, "fit", spied)
    monkeypatch.setattr(quality, "Model", type("Model", (quality.Model,), {"fit": spied, "__module__": "__main__"}))
    for most, size in ((40, 1 << 20), (7, 1 << 20), (40, 80_000)):
        model = quality.train(docs, labels, most, size)
        seen = [int(n) for n in open(folder).read().split()]
        assert 0 < len(seen) <= most and sum(seen) <= size and max(seen) <= size // 100
    assert quality.train(docs.where("false"), labels)[1] == quality.train(docs, labels.where("false"))[1] == 0.0
    scored = quality.score(docs, model)
    assert scored.columns == ["doc_id", "_score", "score"] and dict(scored.dtypes)["score"] == "double" and scored.count() == 41
    assert quality.keep_good(docs, labels, 0.0).collect() == docs.collect()


def test_training_rows_are_held_packed(spark):
    assert inspect.signature(quality.train).parameters["max_train_docs"].default == 5000
    texts = [r.text.encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 500").limit(50).collect()]
    model = quality.Model()
    raw = sum(a.nbytes for t in texts for a in model.bag(t))
    assert sum(len(model.held(t)) for t in texts) < 0.6 * raw
    index, share = model.bag(texts[0])
    kept = unpack(model.held(texts[0]), "i4", "f4")
    assert (kept[0] == index).all() and (kept[1] == share).all()


# --- chat --------------------------------------------------------------------------------

NASTY = ["<|end|>\n", "\\", "\\\\<|", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>", "<<SYS>>x<</SYS>>", "", "\n", "<", "|", "a\\<|b", "ü😀"]


def conversations(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(NASTY)]
    rows += [(2, 5, "assistant", "late"), (2, 1, "system", None), (2, 1, "assistant", "x"), (2, None, "user", "first"), (2, 5, "assistant", "late")]
    rows += [(3, i, "assistant", f"{i}<|") for i in range(700)] + [(None, 0, None, "r"), (4, 0, "user", "only")]
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, opens string")


def test_chat_round_trip(spark):
    rows = conversations(spark)
    want = collections.defaultdict(list)
    key = lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or "")
    for r in sorted(rows.collect(), key=key):
        want[r.conv_id].append((r.role or "", r.text or ""))
    back = chat.read_back(chat.format_conversations(rows, segment_turns=100))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text, r.formatted) for r in back.collect()}
    assert {k: v[0] for k, v in got.items()} == want
    for conv, (turns, loss, formatted) in got.items():
        assert loss == "".join(t for role, t in turns if role == "assistant")
        assert formatted.count(chat.TURN) == sum(i == 0 or turns[i - 1][0] != role for i, (role, _) in enumerate(turns))
        body = formatted.replace(chat.TURN, "").replace(chat.TEXT, "").replace(chat.NEXT, "").replace(chat.END, "")
        assert not any(mark in body for mark in ("<|", *chat.FOREIGN)), conv
    assert chat.format_conversations(rows.where("false")).count() == 0


def test_chat_segments_agree(spark):
    rows = conversations(spark)
    a, b = (chat.format_conversations(rows, n).collect() for n in (3, 10_000))
    assert sorted(map(str, a)) == sorted(map(str, b))


# --- packing -----------------------------------------------------------------------------


def packed_ok(rows, pieces, length):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc_id, text in rows:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], 0
        for p in sorted(own[doc_id], key=lambda p: p.start):
            body = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32, bytes(p.ids)) == (at, len(ids), zlib.crc32(body), body)
            at += p.length
        assert at == len(ids)
    sizes = []
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        sizes.append(at)
        assert at == length or (at < length and at & (at - 1) == 0)
    return sizes


def test_packing_of_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(4)
    pieces = packing.pack_sequences(docs, with_ids=True, group_tokens=30_000).collect()
    sizes = packed_ok([(r.doc_id, r.text) for r in docs.collect()], pieces, 1024)
    assert sum(s == 1024 for s in sizes) * 1024 > 0.9 * sum(sizes)


@pytest.mark.parametrize("weights", [None, {"a": 3.0, None: 0.5}])
def test_packing_of_awkward_rows(spark, weights):
    rows = [(1, None, "a"), (2, "", None), (3, "<|endoftext|> x", "b"), (4, "word " * 3000, "a"), (5, "é\0\n", "b"), (6, "tiny", "c")]
    rows += [(10 + i, f"text number {i} of many", "abc"[i % 3]) for i in range(200)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, tokens int").repartition(3)
    pieces = packing.pack_sequences(docs, 64, weights=weights, window_sequences=2, group_tokens=500, with_ids=True).collect()
    packed_ok([r[:2] for r in rows], pieces, 64)
    assert packing.pack_sequences(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack_sequences(docs, weights={"a": 0.0})


def test_ids_of_every_document(spark):
    """The ranks give the tokenizer's ids on all documents, and on hard Unicode."""
    tokenizer, ranks = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [r.text or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    rng = np.random.default_rng(7)
    points = [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x590, 0x700), *range(0x900, 0xA00), *range(0x2000, 0x2070), *range(0x3040, 0x30A0)]
    points += [*range(0x4E00, 0x4E50), *range(0xAC00, 0xAC40), *range(0xFE00, 0xFE10), 0xFEFF, 0xFFFD, 0xFFFF, *range(0x1F3F0, 0x1F640), 0xE0041, 0x10FFFF, 9, 10, 13]
    texts += ["".join(chr(points[i]) for i in rng.integers(len(points), size=rng.integers(1, 60))) for _ in range(4000)]
    texts += ["e\u0301" * 50, "👩‍👩‍👧‍👦" * 20, "ﷺ", "'S 'LL 'll ’s", "١٢٣ ½ Ⅷ 10²", "\u200d\u200b x", "it'S\u00a0ok\u3000\n\n\n x"]
    for text in texts:
        assert packing.token_ids(text, ranks) == tokenizer.encode(text, add_special_tokens=False).ids


def test_places_of_queues(spark, monkeypatch):
    rows = [((t << 32) + c, s, 10 * t + c + 1) for t in range(5) for c in range(4) for s in ("a", None, "b") if (t + c) % 3 or s == "a"]
    found = packing._places(spark.createDataFrame(rows, "chunk long, source string, tokens long").repartition(4)).collect()
    for source in ("a", "b", None):
        at = 0
        for chunk, s, tokens in sorted(rows, key=lambda r: r[0]):
            if s == source:
                assert next(r["at"] for r in found if r.chunk == chunk and r.source == s) == at
                at += tokens
    assert len(found) == len(rows)


def test_packing_with_wide_ids_and_long_texts(spark, monkeypatch):
    rows = [(1, "many words in one text of some length " * 60_000, "a"), (2, "short", None), (2, "short", None), (None, "no id", "a")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, source string, `at` int, chunk int, body string")
    narrow = packing.pack_sequences(docs).drop("source")
    monkeypatch.setattr(packing, "id_kind", lambda *_: "u4")
    assert sorted(map(str, narrow.collect())) == sorted(map(str, packing.pack_sequences(docs).drop("source").collect()))
    short = narrow.where("doc_id = 2").collect()
    assert sum(r.length for r in short) == 2 * short[0].doc_tokens and narrow.where("doc_id IS NULL").count() >= 1


def test_packing_of_very_long_runs(spark):
    rows = [(1, "\n" * 3_000_000 + "x", "a"), (2, "a" + " " * 2_500_000, "a"), (3, "b" + " \n" * 700_000 + "<|endoftext|> c", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    packed_ok([r[:2] for r in rows], packing.pack_sequences(docs, with_ids=True).collect(), 1024)


def test_runs_cut_out_leave_the_ids(monkeypatch):
    monkeypatch.setattr(packing, "LONG_RUN", 2)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    parts = [*" \n\t\r\v\f\x1c\x1f\x85\xa0\u180e\u2003\u2028\u200b\u3000", " " * 9, "\n" * 5, "a", "1", "é", "!", "'s", packing.END]
    for _ in range(5000):
        text = "".join(parts[i] for i in rng.integers(len(parts), size=rng.integers(1, 20)))
        assert packing.token_ids(text, public_tokenizers.path("byte_bpe_50k.tiktoken")) == tokenizer.encode(text, add_special_tokens=False).ids


def test_windows_hold_the_mixture():
    held = np.array([6000, 3000, 1000])
    sent = packing.round_robin(held / 10_000, np.zeros(3), held, 100)
    at, total = 0, np.zeros(3)
    for queue, n in sent:
        total[queue] += n
        at += n
        if at % 100 == 0:
            assert np.abs(total - held * at / 10_000).max() < 1.5
    assert at == 10_000 and (total == held).all()


def test_schedule_carries_deficits():
    for weights in (None, [1.0, 1.0, 5.0]):
        plan = packing.Schedule([1000, 70, 3], weights, 100)
        for queue, total in enumerate(plan.totals):
            taken = [plan.taken(queue, cut) for cut in range(plan.parts + 1)]
            assert taken == sorted(taken) and taken[0] == 0 and taken[-1] == total
            assert all(0 <= plan.due(queue, c) - plan.taken(queue, c) < 1 for c in range(plan.parts + 1))
            assert all(plan.taken(queue, plan.part_of(queue, at)) <= at < plan.taken(queue, plan.part_of(queue, at) + 1) for at in range(total))


# --- mixing ------------------------------------------------------------------------------


def test_mixing_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mix(docs).collect()
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = water_filled(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert abs(taken[r.source] - r.target) <= 16
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixing_of_awkward_rows(spark):
    rows = [(1, None, "a"), (2, "w " * 900, "a"), (3, "x y", None), (3, "x y", None), (4, "z", ""), (5, None, "empty"), (None, "q", "é")]
    rows += [(i, "many words in one source " * 40, "hot") for i in range(10, 400)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, shard_tokens=1000).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
    want = water_filled(sizes)
    for source in sizes:
        taken = sum(r.taken for r in got if r.source == source)
        shards = max(1, sizes[source] // 1000 + 1)
        assert abs(taken - want[source]) <= 8 + 8 * (shards if want[source] > 1.99 * sizes[source] else 1)
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mixed_documents_of_repeated_rows(spark):
    rows = [(7, "eight words are in this text of one " * 30, "a")] * 6 + [(None, f"no id {i % 3} " * 50, "a") for i in range(9)]
    rows += [(i, "some words " * 100, None) for i in range(40, 60)] + [(61, None, "a"), (61, None, "a")]
    names = "doc_id long, text string, source string, _id int, _copy int, copy int, own int, rows int, times int, row int, size int"
    docs = spark.createDataFrame([(*r, i, i, i, i, i, i, i, i) for i, r in enumerate(rows)], names)
    mixed = mixing.mixed_documents(docs)
    found = mixed.collect()
    assert mixed.columns == docs.columns and all(r._id == r._copy == r["row"] for r in found)
    assert {str(r) for r in found} <= {str(r) for r in docs.collect()}
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    for key in (7, None):
        own = [r for r in found if r.doc_id == key]
        words, held = sum(len(WORD.findall(r.text)) for r in own), sum(len(WORD.findall(r[1])) for r in rows if r[0] == key)
        assert abs(words - taken[key]) <= 2 * 240 and words <= 2 * held
        times = collections.Counter(r._id for r in own)
        assert max(times.values()) <= 2
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixed_documents(docs.repartition(7)).collect()))
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def test_mixing_against_a_slow_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = [tuple(r) for r in docs] + [(None, "w " * 37, None), (5000, None, None), (5001, "é " * 90_000, "long")]
    frame_ = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for shard_tokens in (3000, 65_536):
        got = [(r.doc_id, r.size, r.taken) for r in mixing.mix(frame_, shard_tokens=shard_tokens).collect()]
        assert sorted(got, key=str) == sorted(slow_mix(rows, shard_tokens=shard_tokens), key=str)


def test_apportionment_is_sainte_lague(spark):
    rng = np.random.default_rng(4)
    for seats, share in ((7, 1.0), (100, 1.0), (1001, 1.0), (1001, 0.1), (1001, 0.085)):
        votes = [int(v) for v in rng.integers(0, 1000, 12)]
        most = [int(v * share / 1000 * seats) + int(rng.integers(0, 3)) if share < 1 else seats for v in votes]
        heads = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(most[i])))[:seats]
        want = collections.Counter(i for _, i in heads)
        rows = [(i, float(v), seats, m) for i, (v, m) in enumerate(zip(votes, most))]
        parts = spark.createDataFrame(rows, "tie long, votes double, seats long, most long")
        got = mixing.apportion(parts, [], "votes", "seats", "most", "won").collect()
        assert {r.tie: r.won for r in got} == {i: want[i] for i in range(12)}


# --- scoring -----------------------------------------------------------------------------


def backoff_scores(rows, seen, others=True):
    texts = [(d, WORD.findall(lowered(t))) for d, t in rows]
    count = collections.Counter()
    for _, w in texts:
        for n in (1, 2, 3):
            count.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(v for k, v in count.items() if len(k) == 1)
    out = []
    everything, words = count, total
    for d, w in texts:
        score = 0.0
        if others:
            count = everything.copy()
            for n in (1, 2, 3):
                count.subtract(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            total = max(1, words - len(w))
        for i in range(len(w)):
            if i >= 2 and count[tuple(w[i - 2 : i + 1])] >= seen:
                score += math.log(count[tuple(w[i - 2 : i + 1])] / count[tuple(w[i - 2 : i])])
            elif i >= 1 and count[tuple(w[i - 1 : i + 1])] >= seen:
                score += math.log(0.4 ** (min(i, 2) - 1) * count[tuple(w[i - 1 : i + 1])] / count[(w[i - 1],)])
            else:
                score += math.log(0.4 ** min(i, 2) * (count[(w[i],)] or 0.4) / total)
        out.append((d is None, d or 0, len(w), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("seen", [1, 2, 3])
def test_scores(spark, seen):
    rows = [(1, "a b c a b c d"), (2, "A b c"), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "a b q"), (6, "d a b \t\n c " * 500)]
    for others in (True, False):
        got = lm_scoring.scores(frame(spark, rows).repartition(3), seen, others).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, round(r.log_score, 6)) for r in got) == backoff_scores(rows, seen, others)
    assert lm_scoring.scores(frame(spark, rows).where("false")).count() == 0


def test_scores_of_many_chunks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(chunks, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(chunks, "BATCH_BYTES", 2000)
    monkeypatch.setattr(chunks, "BROADCAST_BYTES", 0)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000, "one very long text " * 20_000)]
    longer = docs.select("doc_id", "text").union(spark.createDataFrame(rows[-1:], "doc_id long, text string"))
    got = lm_scoring.scores(longer).collect()
    want = backoff_scores(rows, 1)
    assert [(r[1], r[2]) for r in want] == sorted((r.doc_id, r.n_words) for r in got)
    assert [r[3] for r in want] == pytest.approx([r.log_score for r in sorted(got, key=lambda r: r.doc_id)], abs=1e-5)


# --- search ------------------------------------------------------------------------------


def best(vectors, asked, k):
    usable = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    scaled = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in usable}
    out = []
    for q, a in sorted(scaled):
        if q in asked:
            found = {}
            for i, b in scaled:
                if i != q:
                    found[i] = max(found.get(i, -math.inf), sum(x * y for x, y in zip(a, b)))
            out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(found.items(), key=lambda p: (-p[1], p[0]))[:k])]
    return sorted(out)


def test_search(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.1, 16)]) for i in range(300)]
    vectors += [(300 + i, vectors[5][1]) for i in range(40)] + [(400, [0.0] * 16), (401, [1.0] * 16), (402, [-1.0] * 16)]
    vectors += [(500, None), (501, [None] * 16), (502, [float("nan")] * 16), (503, [float("inf")] * 16), (504, []), (505, [0.5]), (506, [0.25] * 20)]
    vectors += [(None, [1.0] * 16), (401, [1.0] * 16)]
    table = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, score string")
    asked = {0, 5, 305, 400, 401, 500, 505, 506}
    for block in (50, 8192):
        found = topk.top_k(table, table.where(table.vec_id.isin(*asked)), 5, block_rows=block, query_rows=3)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == best(vectors, asked, 5)
    few = table.where("vec_id IN (0, 5, 7)")
    assert topk.top_k(few, few).count() == 6
    assert topk.top_k(table.where("false"), table).count() == 0


@pytest.mark.parametrize("scale", [2.0**18, 2.0**20.5, 2.0**36])
def test_search_with_large_components(spark, scale):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 64)]) for i in range(200)]
    vectors += [(200 + i, [x * scale for x in v]) for i, v in vectors[:100] if scale < 2.0**30]
    vectors += [(400 + i, [*vectors[i][1][:63], vectors[i][1][63] + 1 / 256]) for i in range(20)]
    vectors += [(500 + i, [scale, 1.0 + i / 256]) for i in range(8 if scale < 2.0**30 else 1)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = {0, 3, 203, 250, 500, 505}
    for block in (60, 8192):
        found = topk.top_k(table, table.where(table.vec_id.isin(*asked)), 5, block_rows=block)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == best(vectors, asked, 5)


def test_search_with_components_beyond_a_long(spark):
    vectors = [(1, [1e30, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = topk.top_k(table, table.where("vec_id = 2"), 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == best(vectors, {2}, 2)


@pytest.mark.parametrize("large", [70000.0, 1e30, 1e200])
def test_search_with_scores_beyond_a_long(spark, large):
    vectors = [(i, [large * (1 + i / 4), 1.0, -large]) for i in range(20)] + [(40 + i, [-large, 2.0 * i, large]) for i in range(20)]
    vectors += [(100 + i, [0.5, float(i)]) for i in range(5)] + [(200, [1e307, 1.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    usable = [v for v in vectors if v[0] != 200]
    for block in (7, 8192):
        found = topk.top_k(table, table.where("vec_id % 50 = 0 OR vec_id = 41"), 5, block_rows=block).collect()
        want = [(*r[:3], max(-(2**63), min(2**63 - 1, r[3]))) for r in best(usable, {0, 41, 50, 100}, 5)]
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == want


def test_bytes_in_the_order_of_integers():
    rng = np.random.default_rng(8)
    numbers = sorted({int(s * 2 ** int(e)) for s in (-1, 1) for e in rng.integers(0, 300, 60)} | {0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63)})
    assert sorted(numbers, key=topk.ordered) == numbers


def test_reading_stops_early_and_without_random_access():
    """Rows are looked at through the lists only, and not to their ends where few vectors point the query's way."""
    rng = np.random.default_rng(6)
    rows = np.floor(rng.normal(0, 20, (4000, 8)))
    rows[:10] += 300
    lists = topk.Lists(np.arange(4000), rows)
    depths = []
    real = topk.Lists.read
    topk.Lists.read = lambda self, q, a, b, base: depths.append((a, b)) or real(self, q, a, b, base)
    try:
        lists.rows = np.abs(rows)  # the bounds must not come from here
        left = topk.contenders(lists, np.ones(8), np.ones(4000, bool), 5)
    finally:
        topk.Lists.read = real
    assert set(np.argsort(-rows.sum(axis=1))[:5]) <= set(left) and len(left) < 100
    assert [b for _, b in depths[:-2]] == [a for a, _ in depths[1:-1]] and depths[-1][0] == 0 and depths[-1][1] < 2000


def test_digests_are_of_whole_texts(spark):
    text = "long " * 100_000
    row = chat.read_back(chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string"))).first()
    assert hashlib.sha256(row.loss_text.encode()).digest() == hashlib.sha256(text.encode()).digest()


def test_each_vector_of_one_vec_id_is_a_query(spark):
    """Two vectors of vec_id 50 are ranked apart; as candidates the better one counts."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0]), (100, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(table, table.where("vec_id % 50 = 0"), 2).collect()
    unit = 256 * 256
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [
        (50, 1, 1, 2 * unit), (50, 1, 2, 3 * unit), (50, 2, 3, unit), (50, 2, 100, 2 * unit), (100, 1, 2, 6 * unit), (100, 2, 3, 3 * unit)
    ]


def test_words_back_off(spark):
    """A text's own n-grams don't count: what others say decides, down to words that no other has."""
    rows = [(1, "a b c"), (2, "a b c"), (3, "b c new"), (4, "alone")]
    got = {r.doc_id: r.log_score for r in lm_scoring.scores(frame(spark, rows)).collect()}
    # b of text 3 in 7 other words; then "b c", seen twice of two; then a word of no other text after a pair.
    assert got[3] == pytest.approx(math.log(2 / 7) + math.log(2 / 2) + math.log(0.4**3 / 7))
    assert got[4] == pytest.approx(math.log(0.4 / 9))


def test_training_texts_are_bounded_before_they_are_gathered(spark):
    """The byte bound holds over sizes; only texts within it reach the task that trains."""
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 300) AS text")
    docs = docs.union(docs.where("doc_id < 5"))
    labels = spark.range(60).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    one = 60 * 300 * 7
    plain = quality.train(docs, labels)
    same = quality.train(docs, labels, max_train_bytes=100 * one)
    assert (plain[0] == same[0]).all() and plain[1] == same[1]
    small = quality.train(docs, labels, max_train_bytes=100 * 2100)
    assert (small[0] != plain[0]).any()
    none = quality.train(docs, labels, max_train_bytes=100)
    assert not none[0].any()


def test_queries_stream_past_the_lists(spark, capfd):
    """Results don't depend on the blocks of queries, and no join pairs them with blocks of candidates."""
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(120)], "vec_id long, embedding array<double>")
    seen = []
    for query_rows in (1, 30, 500):
        found = topk.top_k(table, table, 2, block_rows=30, query_rows=query_rows)
        found.explain()
        plan = capfd.readouterr().out
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "FlatMapCoGroups" not in plan
        seen.append(sorted(map(tuple, found.collect())))
    assert seen[0] == seen[1] == seen[2] == best([(r.vec_id, r.embedding) for r in table.collect()], set(range(120)), 2)


def test_ids_of_every_code_point():
    """The ranks give the tokenizer's ids with every code point between letters, digits, marks and blanks."""
    tokenizer, ranks = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.path("byte_bpe_50k.tiktoken")
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 256):
        text = "".join(f"a{c}1 {c}!{c}  {c}a" for c in points[at : at + 256])
        assert packing.token_ids(text, ranks) == tokenizer.encode(text, add_special_tokens=False).ids


def test_the_largest_doc_id_stands_for_a_missing_one(spark):
    """Operators on chunks and packing give such a row back with a null id, with its result."""
    docs = frame(spark, [(2**63 - 1, "a b c d e f g"), (1, "h i j k l m n")])
    sourced = docs.selectExpr("doc_id", "text", "'s' AS source")
    for found in (suffix_dedup.removals(docs), packing.pack_sequences(sourced), minhash_dedup.near_groups(docs), line_dedup.removed_lines(docs), lm_scoring.scores(docs)):
        assert {r.doc_id for r in found.collect()} == {None, 1}
