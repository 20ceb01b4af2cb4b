"""Brute-force versions of the operators, on rows of (doc_id, text)."""

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = WORD.findall(lowered(text))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def repeated_bytes(rows, width=50):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for at in range(len(data) - width + 1):
            key = data[at : at + width]
            first[key] = min(first.get(key, doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - width + 1):
            if first[data[at : at + width]] < doc_id:
                gone[at : at + width] = b"\1" * width
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def similar_groups(rows, percent):
    sets = {doc_id: shingles(text) for doc_id, text in rows}
    root = {doc_id: doc_id for doc_id in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    holders = collections.defaultdict(list)
    for doc_id in ids:
        for token in sets[doc_id]:
            holders[token].append(doc_id)
    shared = collections.Counter()
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def deduped_lines(rows, percent=80):
    lines = []
    for doc_id, text in sorted(rows):
        lines += [(doc_id, n, shingles(line)) for n, line in enumerate((text or "").split("\n"))]
    gone = set()
    for i, (doc_id, n, tokens) in enumerate(lines):
        for _, _, other in lines[:i]:
            inter = len(tokens & other)
            if inter and 100 * inter >= percent * (len(tokens) + len(other) - inter):
                gone.add((doc_id, n))
                break
    out = {}
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = "\n".join(line for n, line in enumerate(own) if (doc_id, n) not in gone)
        out[doc_id] = (len(own), sum((doc_id, n) in gone for n in range(len(own))), hashlib.sha256(kept.encode()).hexdigest())
    return out


def frame(spark, rows, extra=True):
    """Documents with an extra column whose name clashes with names that operators use."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    wide = [(d, t, "src", d, "x", 1, b"x") for d, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, chunk long, key string, n int, body binary")


def slow_score(text, table, bias):
    """The classifier's score of one text (bytes), feature by feature, with the rules stated anew."""
    full, mix, prime, buckets = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0x100000001B3, len(table)

    def bucket(x, salt):
        x = ((x ^ (salt * 0x632BE59BD9B4E019 & full)) * mix) & full
        x = ((x ^ (x >> 29)) * mix) & full
        return (x >> 32) % buckets

    def kind(b):
        if b in b" \t\n\x0b\x0c\r":
            return 0
        return 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b >= 128 else 5 + b % 8

    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", text) if w]
    hashes = [sum((b + 1) * pow(prime, i, 1 << 64) for i, b in enumerate(w)) & full for w in words]
    shapes = []
    for i, w in enumerate(words):
        again = sum(1 << back for back in (1, 2, 3) if i >= back and words[i - back] == w)
        signs = min(4, sum(kind(b) not in (1, 2, 4) for b in w))
        loud = sum(kind(b) == 2 for b in w) > 1
        shapes.append((((kind(w[0]) * 16 + kind(w[-1])) * 16 + again) * 2 + loud) * 8 + signs)
    pairs = lambda x: [(a * mix + b) & full for a, b in zip(x, x[1:])]
    whole = text + b" "
    grams = lambda n: [int.from_bytes(whole[i : i + n], "big") for i in range(len(whole) - n + 1)]
    families = [hashes, pairs(hashes), shapes, pairs(shapes), grams(3), grams(5)]
    total = bias
    for salt, values in enumerate(families, 1):
        total += sum(float(table[bucket(v, salt)]) for v in values) / max(1, len(values)) / len(families)
    return 1 / (1 + math.exp(-max(-50, min(50, total))))


def water_filled(sizes, weights=(5, 2, 1), budget=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = budget * sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return target


def slow_mix(rows, weights=(5, 2, 1), budget=1.5, cap=2, block=8, shard_tokens=65_536, seed=0):
    """The mix by ranking all quotients and walking the streams word by word; rows of (doc_id, text, source)."""
    seeded = lambda *parts: int(hashlib.md5("/".join(map(str, (seed, *parts))).encode()).hexdigest()[:15], 16)

    def seats(votes, count, most, ties):
        heads = [(-v / (2 * k + 1), ties[i], k, i) for i, v in votes.items() if v for k in range(min(most[i], count))]
        return collections.Counter(h[3] for h in sorted(heads)[:count])

    sizes = {i: len(WORD.findall(t or "")) for i, (_, t, _) in enumerate(rows)}
    held = collections.Counter()
    for i, (_, _, s) in enumerate(rows):
        held[s] += sizes[i]
    target = water_filled(held, weights, budget)
    tie = {s: seeded("source", "" if s is None else "=" + s) for s in held}
    quota = seats(target, round(sum(target.values()) / block), {s: cap * held[s] // block for s in held}, tie)
    taken = {}
    for s in held:
        shards, streams = max(1, -(-held[s] // shard_tokens)), collections.defaultdict(list)
        for i, (d, _, source) in enumerate(rows):
            if source == s:
                place = seeded("place", "" if d is None else d)
                streams[place % shards].append((place >> 16, d is not None, d or 0, sizes[i], i))
        volume = {n: sum(x[3] for x in stream) for n, stream in streams.items()}
        own = {n: seeded("shard", tie[s], n) for n in streams}
        blocks = seats(volume, quota[s], {n: cap * volume[n] // block for n in streams}, own)
        for n, stream in streams.items():
            flat = [x[4] for x in sorted(stream) for _ in range(x[3])]
            start = seeded("start", own[n]) % max(1, -(-len(flat) // block)) * block
            taken[s, n] = collections.Counter(flat[(start + k) % len(flat)] for k in range(blocks[n] * block)) if flat else {}
    return [(rows[i][0], sizes[i], sum(t[i] for t in taken.values() if i in t)) for i in sizes]
