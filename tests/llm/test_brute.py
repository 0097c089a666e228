"""The pipeline and the secret scan against versions that share no code with the library."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import regex
import xxhash

import corpus_pipeline
from provenant.llm import packing, secrets
from tests.llm.test_operators import DOCS, WORD, brute_fingerprint, brute_removed, brute_targets, common_key, find_all

SPACE = " \t\n\x0b\x0c\r"


def grams(text):
    """Counts of runs of one to three characters of the padded words; a run must hold a letter at its place."""
    line = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
    line = regex.sub(" +", " ", line)
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if (n == 1 and g != " ") or n == 2 or (n == 3 and g[1] != " "):
                found[g] += 1
    return found


def top(counts):
    place = lambda g: sum((1 if c == " " else ord(c)) << 21 * i for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], place(x[0])))][:300]


def brute_language(docs):
    total = {}
    for d in docs:
        if d[1] is not None and d[2] is not None:
            total.setdefault(d[2], Counter()).update(grams(d[1]) if any(c.isalpha() for c in d[1]) else {})
    ranks = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in total.items()}
    out = []
    for doc, text, _, source, n in docs:
        if text is None or not any(c.isalpha() for c in text):
            continue
        mine = top(grams(text))
        far = {lang: sum(min(300, abs(r[g] - i)) if g in r else 300 for i, g in enumerate(mine)) for lang, r in ranks.items()}
        out.append((doc, text, min(sorted(far), key=far.get), source, n))
    return out


def brute_line_stage(docs):
    out = []
    for d, (_, text, _, gone) in zip(docs, brute_removed([d[:2] for d in docs])):
        if not gone or text.strip(SPACE):
            out.append((d[0], text, d[2], d[3], len(text)))
    return out


def brute_near(docs):
    prints = [brute_fingerprint(d[1]) for d in docs]
    label = find_all(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    best = {}
    for i, d in enumerate(docs):
        place = (d[0] is None, d[0] or 0, common_key(d[1]))
        best[label[i]] = min(best.get(label[i], (place, i)), (place, i))
    return [docs[i] for _, i in best.values()]


def spark_hash(seed, doc, size):
    """Spark's XXH64 of an int and two longs: each value is hashed with the hash so far as its seed."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    for value in (doc, size):
        h = xxhash.xxh64_intdigest(struct.pack("<q", value), h)
    return h - (1 << 64) if h >> 63 else h


def brute_mix(docs):
    words = [WORD.findall(d[1].encode()) for d in docs]
    sizes = Counter()
    for d, w in zip(docs, words):
        sizes[d[3]] += len(w)
    goals, out = {s: int(round(g)) for s, g in brute_targets(dict(sizes)).items()}, []
    for source in sizes:
        rows = sorted((i for i, d in enumerate(docs) if d[3] == source), key=lambda i: (spark_hash(7, docs[i][0], len(words[i])), docs[i][0]))
        left = goals[source]
        while left > 0 and sizes[source]:
            for i in rows:
                take = min(left, len(words[i]))
                if take == len(words[i]) and take:
                    out.append((docs[i][0], docs[i][1]))
                elif take:
                    out.append((docs[i][0], b" ".join(words[i][:take]).decode()))
                left -= take
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(21)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "éèüöqrst"}
    vocabulary = {lang: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(300)] for lang, a in letters.items()}

    def line(lang):
        return " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randrange(3, 12)))

    shared = {lang: [line(lang) for _ in range(12)] for lang in letters}
    docs = []
    for i in range(90):
        lang = rng.choice(list(letters))
        body = [line(lang) for _ in range(rng.randrange(1, 14))]
        if i % 3 == 0:
            body[1:1] = shared[lang]
        docs.append((i * 7, "\n".join(body), None if i % 5 == 0 else lang, [None, "big", "big", "small", "tiny"][i % 5] if i > 6 else "rare", 0))
    docs += [(1000 + i, docs[3][1], "aa", "big", 0) for i in range(5)] + [(1100, docs[8][1] + " end", None, "big", 0), (1101, None, "aa", "big", 0), (1102, " 12 !", "aa", "small", 0), (1103, "\n".join(shared["aa"]), "aa", "small", 0)]
    long = " ".join(rng.choice(vocabulary["bb"]) for _ in range(400))
    docs += [(2000, long, "bb", "big", 0), (2001, long, "bb", "small", 0), (2002, long + " more", "bb", "big", 0), (1999, long + " and", None, "tiny", 0)]
    docs = [(a, b, c, d, len(b or "")) for a, b, c, d, _ in docs]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")

    one = brute_language(docs)
    assert {d[0] for d in docs} - {d[0] for d in one} == {1101, 1102}
    two = brute_line_stage(one)
    three = brute_near(two)
    assert len(three) < len(two)
    four = brute_mix(three)
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = [(doc, np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")) for doc, text in four]
    pieces, sequences = {}, {}
    for p in got:
        pieces.setdefault((p["doc_id"], p["copy"]), []).append(p)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert len(pieces) == len(four)
    wanted = Counter((doc, len(x), zlib.crc32(x.tobytes())) for doc, x in ids)
    by_doc = {}
    for doc, x in ids:
        by_doc.setdefault((doc, len(x)), []).append(x)
    found = Counter()
    for (doc, _), parts in pieces.items():
        parts.sort(key=lambda p: p["start"])
        n = parts[0]["doc_tokens"]
        assert [p["start"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts]])[:-1].tolist() and sum(p["length"] for p in parts) == n
        own = next(x for x in by_doc[(doc, n)] if all(zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in parts))
        found[(doc, n, zlib.crc32(own.tobytes()))] += 1
    assert found == wanted
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


def test_secrets_against_brute_force(spark):
    """The contract's patterns as they stand there, and the links by all pairs of parts."""
    assign = regex.compile(r"(password|passwd|secret|token|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)".replace("password|passwd|secret|token", "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))))
    rng = random.Random(8)
    key, weak, address = "AKIA" + "Q7" * 8, "aB3dE5gH7jK9mN1pQ3sT5vW7xY", "https://db.example.com/x"
    parts = [key, weak, address, "ID ABCD1234EFGH5678", "password: 'hunter22x'", "Api_Key=short", "toKen = abc.def-ghi", "deadbeef" * 4, "host = db.internal:5432", "ſecret=12345678"]
    texts = [None, "", "é" * 50]
    for _ in range(150):
        texts.append("".join(rng.choice(parts) + " " + "zé " * rng.choice([1, 20, 60, 90]) for _ in range(rng.randrange(1, 9))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find(docs)).collect()}
    linked_weak = 0
    for i, text in enumerate(texts):
        text = text or ""
        base = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 8]
        base += [("access", *m.span()) for m in regex.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [("hex", *m.span()) for m in regex.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        order = {"assign": 0, "access": 1, "hex": 2}
        base.sort(key=lambda s: (s[1], order[s[0]]))
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in order] == [sum(s[0] == k for s in base) for k in order]
        spans = [tuple(s.split(":")) for s in got[i]["spans"].split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans if k in order} == set(base)
        # every place where a weak part stands, and whether a complement lies within 200 code points of it
        places = [("weak_secret", m.start(), m.end()) for m in regex.finditer(weak, text)] + [("endpoint", m.start(), m.end()) for m in regex.finditer(regex.escape(address) + "|host = db.internal:5432", text)]
        places += [("weak_id", m.start(1), m.end(1)) for m in regex.finditer("ID (ABCD1234EFGH5678)", text)]
        part = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
        needs = {"weak_id": {"secret"}, "weak_secret": {"id", "endpoint"}, "endpoint": {"secret"}}
        want = {(k, a, b) for k, a, b in places if any(part[o] in needs[k] and c < b + 200 and a - 200 < d for o, c, d in [*base, *places])}
        assert {(k, int(a), int(b)) for k, a, b in spans if k not in order} == want
        linked_weak += len(want)
    assert linked_weak > 100
