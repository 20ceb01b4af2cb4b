"""Conversation repair, personal data and source divergence against slow versions, and on awkward rows."""

import collections
import hashlib
import heapq
import random
import re
import time

import pyarrow as pa
import pytest

from crawlsight.llm import conversation_repair, pii, source_divergence

# --- conversation repair ------------------------------------------------------------------


def slow_repair(rows):
    """Cost, audit and turns of the cheapest edits, by trying all in order of (cost, audit)."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while True:
        cost, audit, at, initials, turns = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, list(turns)
        if (at, initials) in done or not re.match("(s?(ua)*u?)$", initials):
            continue
        done.add((at, initials))
        for role in ("user", "assistant"):
            if len(initials) <= len(rows) + 2:
                heapq.heappush(heap, (cost + 5, audit + "I", at, initials + role[0], (*turns, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, initials, turns))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if role:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials + role[0], (*turns, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, initials + new[0], (*turns, (new, text))))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_repair_against_all_edits(spark):
    rng = random.Random(5)
    rows, wanted = [], {}
    for conv in range(250):
        own = [(rng.choice(["user", "assistant", "user", "system", "tool", "", "start"]), rng.choice(["A.", "b?", "c", " \n", "", "Dd!", "e e. "])) for _ in range(rng.randint(1, 7))]
        cost, audit, turns = slow_repair(faults(own))
        rows += [(conv, i, *r) for i, r in enumerate(own)]
        wanted[conv] = cost, audit, turns, [f for _, _, f in faults(own)], own
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    planned = conversation_repair.plans(frame).cache()
    for r in planned.collect():
        cost, audit, _, found, own = wanted[r.conv_id]
        assert (r.cost, r.audit, r.gaps) == (cost, audit, 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(found.count(f) for f in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    turns = collections.defaultdict(list)
    for r in sorted(conversation_repair.repaired_turns(frame, planned).collect()):
        assert r.n == len(turns[r.conv_id])
        turns[r.conv_id].append((r.role, r.text))
    digests = {r.conv_id: r.repaired_sha256 for r in conversation_repair.repaired_digests(frame, planned).collect()}
    assert len(digests) == 250
    for conv, (_, _, want, _, _) in wanted.items():
        assert turns[conv] == want
        assert digests[conv] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in want).encode()).hexdigest()


def test_long_conversations_freeze_their_audits():
    """Tails that are cut and ranked give the audits that whole strings give."""
    for seed in range(6):
        rng = random.Random(seed)
        roles = [rng.choice("uuua" if seed % 2 else "us")[0] for _ in range(4000)]
        kinds = [rng.choice([None, None, "truncated", "blank"]) if seed > 2 else None for _ in roles]
        search = conversation_repair.Viterbi()
        whole = [(0, ""), None, (5, "I"), (10, "II")]
        for i, (role, fault) in enumerate(zip(roles, kinds)):
            search.row(i, role, fault)
            new = [[p and (p[0] + 2, p[1] + "D")] for p in whole]
            if fault != "blank":
                for state, p in enumerate(whole):
                    extra = 5 if fault else 0
                    to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}[role].get(state)
                    if p and to is not None:
                        new[to].append((p[0] + extra, p[1] + "K"))
                    if p:
                        new[3 if state == 2 else 2].append((p[0] + 1 + extra, p[1] + "R"))
            whole = [min((p for p in paths if p), default=None) for paths in new]
            for to in (2, 3, 2, 3):
                froms = (0, 1, 3) if to == 2 else (2,)
                whole[to] = min((p for p in [whole[to], *[whole[f] and (whole[f][0] + 5, whole[f][1] + "I") for f in froms]] if p), default=None)
        found = search.result()
        assert (found["cost"], found["audit"]) == min(whole[0], whole[3])
        assert all(len(p[2]) < 2 * conversation_repair.FREEZE for p in search.layer if p)


def test_repair_on_awkward_rows(spark):
    long = "word " * 300_000 + "end."
    rows = [(1, None, "user", "first."), (1, 3, "user", "a."), (1, 3, "user", "a."), (1, 7, None, "x."), (1, 7, "assistant", None)]
    rows += [(None, 0, "user", long), (None, 1, "assistant", "ok."), (2, None, None, None), (3, 5, "assistant", "only.")]
    names = ("cost", "audit", "row", "seen", "fault", "digest", "n", "initial", "blank")
    frame = spark.createDataFrame([(*r, *[i] * len(names)) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} int" for n in names))
    found = {r.conv_id: r for r in conversation_repair.plans(frame).collect()}
    again = {r.conv_id: r for r in conversation_repair.plans(frame.repartition(6)).collect()}
    assert found == again and set(found) == {1, 2, 3, None}
    assert (found[1].gaps, found[1].blank, found[1].duplicate, found[1].truncated) == (3, 1, 1, 0)
    assert (found[2].audit, found[2].cost, found[2].gaps, found[2].blank) == ("D", 2, 0, 1)
    assert (found[3].audit, found[3].cost, found[None].audit, found[None].cost) == ("D", 2, "KK", 0)
    turns = conversation_repair.repaired_turns(frame, conversation_repair.plans(frame)).where("conv_id IS NULL").orderBy("n").collect()
    assert [(r.role, r.text) for r in turns] == [("user", long), ("assistant", "ok.")]
    none = frame.where("false")
    assert conversation_repair.plans(none).count() == 0 == conversation_repair.repaired_turns(none, conversation_repair.plans(none)).count()
    assert conversation_repair.repaired_digests(none, conversation_repair.plans(none)).count() == 0


# --- personal data ------------------------------------------------------------------------

_SLOW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_spans(text):
    for kind, regex in _SLOW.items():
        for m in re.finditer(regex, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                yield kind, m.start(), m.end()
            elif kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                yield kind, m.start(), m.end()


@pytest.mark.parametrize("letters", ["ab1234567890..--@@++  ()é_%:/", "0123456789- .+", "a.@-é€1"])
def test_base_spans_against_expressions(letters):
    rng = random.Random(len(letters))
    for _ in range(8000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        assert [s[:3] for s in pii.character_spans(text.encode()) if s[3]] == list(slow_spans(text)), text


def test_spans_beyond_the_base():
    def found(text):
        return [(k, text[a:b], base) for k, a, b, base in pii.character_spans(text.encode())]

    assert found("an jörg.é@exämple.de!") == [("email", "jörg.é@exämple.de", False)]
    assert found("x@a.bé") == [("email", "x@a.b", True), ("email", "x@a.bé", False)]
    assert found("SSH://joe:pw@host") == [("address", "joe:pw@host", False)]
    assert found("see http://host/x and mail://a@b") == []
    assert found("My IBAN: DE89 3704 0044 0532 0130 00.") == [("account", "DE89 3704 0044 0532 0130 00", False)]
    assert found("iban GB82WEST12345698765432") == [("account", "GB82WEST12345698765432", False)]
    assert found("iban DE89 3704 0044 0532 0130 01") == found("iban DE89 3704 0044 0532 0130 009") == found("DE89370400440532013000") == []
    assert pii.redact("mail jörg@a.de or 1.2.3.4, card 4111 1111 1111 1111".encode()).decode() == "mail [EMAIL] or [IP], card [CARD]"


def test_spans_take_linear_time():
    began = time.time()
    for piece in ("1", "1.", "1-", "a@", "+1", "a", "é", "http://a", "iban", "ä@b."):
        pii.character_spans(piece.encode() * 300_000 + b"@b.c")
    assert time.time() - began < 40


def test_spans_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c"), (4, "x " * 2_000_000 + "a@b.c")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, spans int, kind int")
    found = collections.Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in pii.find_spans(frame).collect())
    email = ("email", 0, 5)
    assert found == {(1, ()): 1, (2, ()): 1, (None, (email,)): 1, (3, (email,)): 2, (4, (("email", 4_000_000, 4_000_005),)): 1}
    assert {r.doc_id: r.text[-7:] for r in pii.redacted(frame).collect()} == {1: "", 2: "", None: "[EMAIL]", 3: "[EMAIL]", 4: "[EMAIL]"}
    assert pii.find_spans(frame.where("false")).count() == 0


# --- source divergence --------------------------------------------------------------------


def slow_divergence(rows, least=3, top=200):
    counts, groups, df = collections.defaultdict(collections.Counter), collections.defaultdict(set), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), collections.Counter()))
        far = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-far(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, -value, rank))
    return out


def test_divergence_against_slow_version(spark):
    rng = random.Random(3)
    words = ["A", "b", "É", "é", "don't", "x1y", "ﬁ", "zz", "Zz", "𝒳", "_u_", "long" * 50]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"]), " ".join(rng.choices(words, weights=range(1, 13), k=rng.randint(0, 30)))) for _ in range(150)]
    rows += [("de", "s1", None), ("de", "s2", ""), ("xx", "alone", "a a a"), ("xx", "alone", "a"), ("xx", "alone", "a b"), ("en", "s1", "b " * 100_000), *[("en", "s1", "b zz")] * 3]
    names = ("term", "block", "n", "df", "value", "rank", "total", "vocabulary")
    frame = spark.createDataFrame([(i // 2, *r, *[i] * len(names)) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, " + ", ".join(f"{n} int" for n in names))
    found = [tuple(r) for r in source_divergence.divergence(frame.repartition(5), top=4).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == slow_divergence(rows, top=4)
    assert source_divergence.divergence(frame.where("false")).count() == 0


def test_runs_span_batches():
    """Runs are the same however sorted rows fall into batches, and hold three rows at most."""
    rng = random.Random(1)
    rows = sorted((rng.choice("ab"), rng.choice("stuvw"), rng.choice("123456"), i, rng.randint(1, 5), rng.randint(1, 2)) for i in range(300))
    df, n = collections.Counter(), collections.Counter()
    for lang, term, source, _, count, docs in rows:
        df[lang, term] += docs
        n[lang, term, source] += count
        n[lang, term, None] += count
    for size in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_pydict(dict(zip(("lang", "term", "source", "block", "n", "df"), map(list, zip(*rows[i : i + size]))))) for i in range(0, 300, size)]
        for least in (1, 3, 60):
            found = [tuple(r.values()) for b in source_divergence._sorted_runs(iter(batches), least) for r in b.to_pylist()]
            assert len(found) == len(set(found)) and {r[:3]: r[3] for r in found} == {k: v for k, v in n.items() if df[k[:2]] >= least}


def test_pairs_span_batches(monkeypatch):
    """Terms and summed pairs don't depend on batches, nor on how many pairs are summed at once."""
    rng = random.Random(2)
    rows = [("en", t, s, rng.randint(1, 10**9), rng.randint(1, 1000)) for t in "abcdefgh" for s in [None, *sorted(rng.sample("123456789", rng.randint(1, 9)))]]
    names = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("p", pa.int64()), ("none", pa.int64())])

    def found(size):
        batches = [pa.RecordBatch.from_pydict(dict(zip(names.names, map(list, zip(*rows[i : i + size])))), names) for i in range(0, len(rows), size)]
        out = collections.Counter()
        for b in source_divergence._compared(iter(batches)):
            for r in b.to_pylist():
                out[r["source"], r["item"], r["is_term"]] += r["value"]
        return out

    want = found(len(rows))
    assert want and all(found(size) == want for size in (1, 5, 30))
    monkeypatch.setattr(source_divergence, "PAIRS", 10)
    assert found(8) == want
