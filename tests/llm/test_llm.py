"""The training-data operators against brute force and on hard rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitgraph.llm import fingerprints, licenses, minhash, mixing, packing, quality, queries, secrets, substring, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


BASE = prose(1, 120)
TEXTS = [BASE, BASE, BASE.replace(" ", "\n", 3) + " tail", prose(2, 80), None, "", "one", "one", "x " * 3000, prose(3, 30) + " " + " ".join(BASE.split()[20:90]), "É b c\x0bd", prose(4, 60) + " " + BASE]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], ["a", "b", None][i % 3], len(t or ""), "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def shingles(t, n=2):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, empty):
    out = by_id(minhash.near_duplicates(docs, shingle=2))
    sets, least = {i: shingles(t) for i, t in enumerate(TEXTS)}, list(range(len(TEXTS)))
    for _ in TEXTS:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    for i in sets:
        assert (out[i]["n_shingles"], out[i]["component_id"], out[i]["kept"]) == (len(sets[i]), least[i], least[i] == i)
    assert minhash.near_duplicates(empty).collect() == []


def test_long_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHORT", 3)
    rng, base = np.random.default_rng(5), prose(9, 100).split()
    texts = []
    for _ in range(40):
        w = list(base)
        for k in rng.choice(100, rng.integers(0, 12), replace=False):
            w[k] = "".join(rng.choice(list("stuvw"), 5))
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, sets, least = by_id(minhash.near_duplicates(df, shingle=2)), [shingles(t) for t in texts], list(range(40))
    for _ in range(40):
        for a in range(40):
            for b in range(40):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    assert [out[i]["component_id"] for i in range(40)] == least
    assert len(set(least)) > 1


def test_fingerprints(docs, empty):
    out = by_id(fingerprints.fingerprint(docs))
    ids = sorted(out, reverse=True)
    for k, i in enumerate(ids):
        mine, nxt = TEXTS[i] or "", TEXTS[ids[(k + 1) % len(ids)]] or ""
        half = len(mine) // 2
        assert out[i]["edited_sha256"] == hashlib.sha256((mine[: len(mine) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
    assert out[0]["fingerprint"] == out[1]["fingerprint"] and out[4]["fingerprint"] == out[5]["fingerprint"] == ""
    assert fingerprints.fingerprint(empty).collect() == []


def test_fingerprint_does_not_depend_on_what_was_read_before(monkeypatch):
    """Terms that tie in a sample, in either order, read before or for the first time."""
    draw = fingerprints.sample_terms
    # One bit of ln a is left, so that ties are everywhere.
    monkeypatch.setattr(fingerprints, "sample_terms", lambda k, w, n: draw(k, w, n) & ~np.uint64(0x7FFFFFFF0000))
    texts = [prose(40 + i, 30) for i in range(12)]
    fresh = {t: fingerprints.Fingerprinter().signature(t.encode()).tolist() for t in texts}
    for cache in (0, 5, 200, 1000):
        make = fingerprints.Fingerprinter(cache=cache)
        for t in [*texts, *reversed(texts)]:
            assert make.signature(t.encode()).tolist() == fresh[t]
            assert make.signature(" ".join(reversed(t.split())).encode()).tolist() == fresh[t]


def test_fingerprint_is_generalised_jaccard():
    a, b = Counter("aabbbcd"), Counter("abbcccde")
    make = lambda c: fingerprints.Fingerprinter(4000).signature(" ".join(c.elements()).encode())
    true = sum((a & b).values()) / sum((a | b).values())
    assert abs(fingerprints.likeness(make(a), make(b)) - true) < 0.04


def test_secrets(spark, empty):
    live, example = "Zx9k" * 4 + "q1", "EXAMPLE1key" * 2
    texts = [f"é PassWord = '{live}' x", None, "", f"token: abc secret=token: longenough1 AKIA{'B2' * 9}", "deadbeef" * 3 + " api-key=nothing1", "paſſword=abcdef1"] + [f"token={example}"] * 4
    df = spark.createDataFrame([(i, t, f"s{i}", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, value string")
    out = by_id(secrets.find_secrets(df, "doc_id", F.col("source"), F.col("source")))
    assert [out[i]["n_assign"] for i in range(10)] == [1, 0, 0, 0, 0, 0, 1, 1, 1, 1]
    assert (out[3]["n_access"], out[4]["n_hex"]) == (1, 1)
    assert out[0]["spans_text"] == f"assign:2:{len(texts[0]) - 3},live:14:{14 + len(live)}"
    assert [out[i]["n_example"] for i in range(6, 10)] == [1] * 4 and out[6]["n_live"] == 0
    fixed = by_id(secrets.redact(df, secrets.find_secrets(df, "doc_id", F.col("source"), F.col("source")), "doc_id"))
    assert fixed[0]["text"] == "é PassWord = '[secret]' x" and fixed[6]["text"] == texts[6] and fixed[1]["text"] is None and len(fixed) == 10
    assert secrets.find_secrets(empty, "doc_id", F.col("source"), F.col("lang")).collect() == []


def base_spans(text):
    """The contract's patterns, one alternative at a time, character by character."""
    out, letters = [], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = set(letters + letters.lower() + "0123456789+/_.=-")
    low = "".join(c.lower() if c in letters else c for c in text)

    def run(i, allowed):
        j = i
        while j < len(text) and text[j] in allowed:
            j += 1
        return j

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, i):
                j = i + len(word)
                j += text[j : j + 1] in ("'", '"')
                j = run(j, " ")
                if text[j : j + 1] not in (":", "="):
                    return None
                j = run(j + 1, " ")
                j += text[j : j + 1] in ("'", '"')
                end = run(j, value)
                return (end, end - j >= 6) if end > j else None
        return None

    def access(i):
        end = run(i + 4, letters + "0123456789") if text.startswith("AKIA", i) else i
        return (end, end - i >= 20) if end > i + 4 else None

    def hex_(i):
        end = run(i, "0123456789abcdef")
        return (end, end - i >= 24) if end > i else None

    for rank, (kind, match) in enumerate((("assign", assign), ("access", access), ("hex", hex_))):
        i = 0
        while i < len(text):
            m = match(i)
            if m and m[1]:
                out.append((i, rank, f"{kind}:{i}:{m[0]}"))
            i = m[0] if m else i + 1
    return ",".join(x for *_, x in sorted(out))


def test_secrets_against_brute_force(spark):
    """Base spans of random pieces, and verdicts from owners and repositories counted one by one."""
    rng = np.random.default_rng(21)
    pieces = ["token", "Secret", "api_key", "APIKEY", "passwd", " ", ":", "=", "'", '"', "AKIA", "B2C4D6E8F0G1H3J5", "deadbeef0123", "9af", "x9Yz", "é", "\n", "AKIA7", "password"]
    values = [f"{i}aB{i * 7919:x}Zq" for i in range(30)]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(pieces, rng.integers(0, 25))) + " "
        text += "".join(f" token={values[k]}" for k in rng.integers(0, 30, 2)) if i % 2 else ""
        k = int(rng.integers(0, 40))
        rows.append((i, text, None if k == 0 else f"o{k % 6 if i % 3 else k}", f"r{k}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    out = by_id(secrets.find_secrets(df, "doc_id", F.col("repo"), F.col("owner")))
    owners, repos = {}, {}
    for _, text, o, r in rows:
        for *_, v in secrets.find(text):
            owners.setdefault(v, set()).add(o)
            repos.setdefault(v, set()).add(r)
    seen = Counter()
    for i, text, *_ in rows:
        assert out[i]["base"] == base_spans(text), text
        assert out[i]["n_assign"] + out[i]["n_access"] + out[i]["n_hex"] == (len(base_spans(text).split(",")) if base_spans(text) else 0)
        found = {(at, v) for *_, at, v in secrets.find(text)}
        copied = {at for at, v in found if len(owners[v]) >= 3 or len(repos[v]) >= 5}
        live = {at for at, v in found if secrets.looks_random(v) and len(owners[v]) < 3 and len(repos[v]) < 5}
        assert (out[i]["n_example"], out[i]["n_live"]) == (len(copied), len(live))
        seen.update(copied=len(copied), live=len(live))
    assert seen["copied"] > 20 and seen["live"] > 20


def test_many_repositories_of_one_owner_make_an_example(spark):
    df = spark.createDataFrame([(i, "token=Abc123xyz", "o", f"r{i % n}") for n in (4,) for i in range(8)], "doc_id long, text string, owner string, repo string")
    found = lambda d: {r["n_live"] for r in secrets.find_secrets(d, "doc_id", F.col("repo"), F.col("owner")).collect()}
    assert found(df) == {1}
    assert found(df.withColumn("repo", F.col("doc_id").cast("string"))) == {0}


def test_redact_overlapping_spans(spark):
    hex_, key = "0123456789abcdef01234567", "AKIA" + "B2C4D6E8" * 2
    cases = {
        f"a token={hex_}.TailPart9 b": "a token=[secret] b",
        f"a secret={key}/Tail9x b": "a secret=[secret] b",
        f"a AKIA{'0123456789' * 2}{'abcdef' * 2} b": "a [secret] b",
        f"a token=Head9.{hex_}.Tail b {key} c": "a token=[secret] b [secret] c",
    }
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(cases)], "doc_id long, text string, source string")
    fixed = by_id(secrets.redact(df, secrets.find_secrets(df, "doc_id", F.col("source"), F.col("source")), "doc_id"))
    assert [fixed[i]["text"] for i in range(len(cases))] == list(cases.values())


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "same é"), (2, None, "same é"), (5, "http://c\r\nX: y", "same é"), (3, "u", None), (4, "u", ""), (6, "u", "z" * 3_000_000), (7, "u", "\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    index, read = warc.archive(pages, str(tmp_path / "w"))
    out = by_id(read, "page_id")
    assert {i: (r["record_type"], r["refers_to"]) for i, r in out.items()} == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert out[1]["payload_bytes"] == 7 and out[6]["payload_bytes"] == 3_000_000
    assert out[2]["payload_digest"] == base64.b32encode(hashlib.sha1("same é".encode()).digest()).decode()
    assert index.count() == 7
    assert {r["record_type"] for r in warc.archive(pages, str(tmp_path / "v"), min_bytes=4_000_000)[1].collect()} == {"response"}
    assert warc.archive(pages.limit(0), str(tmp_path / "e"))[1].collect() == []


def test_packing(docs, empty):
    path = queries.tokenizer()
    encoder = packing.Encoder(path)
    for t in ["a  b", "x \n y", "", "   ", " <|endoftext|> z", "don't  \n\n stop ", "日本 語", *[t or "" for t in TEXTS]]:
        assert encoder.encode(t) == np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes()
    rows = packing.pack(docs, path, sequence=64, window_tokens=500).collect()
    full = {i: [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    seen, sequences = Counter(), {}
    for r in rows:
        part = full[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(full[r["doc_id"]])
        seen.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(n == 1 for n in seen.values()) and len(seen) == sum(map(len, full.values()))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == max(sequences)
    assert packing.pack(empty, path).collect() == []


def test_mixing(docs, empty):
    out = mixing.mix(docs, block_words=16)
    rows = out.collect()
    for r in rows:
        assert r["size"] == len(WORD.findall(TEXTS[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"]
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, r["target"]])
        s[0] += r["taken"]
    assert all(abs(t - round(g)) <= 0 for t, g in by.values())
    assert sorted(map(tuple, mixing.mix(docs, block_words=16).drop("_row").collect())) == sorted(map(tuple, out.drop("_row").collect()))
    assert mixing.mix(empty).collect() == []


def test_targets(spark):
    def shares(sizes, weights, budget):
        df = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "at long, size long, weight double")
        level = mixing.water_level(df, budget, 2)
        return [min(2.0 * s, level * w) for s, w in zip(sizes, weights, strict=True)]

    assert shares([10, 10, 10], [5, 2, 1], 45) == [20, 50 / 3, 25 / 3]
    assert shares([], [], 0) == [] and shares([0, 4], [1, 1], 6) == [0, 6]


@pytest.mark.parametrize("few", [100_000, 0])
def test_schedule_keeps_shares(spark, few):
    """Every rank has one slot, in order, and any run of slots holds each source in its share."""
    blocks = [300, 0, 120, 7, 73]
    rows = mixing.schedule(spark.createDataFrame(list(enumerate(blocks)), "at long, blocks long"), few).orderBy("slot").collect()
    assert sorted((r["at"], r["rank"]) for r in rows) == [(i, k) for i, n in enumerate(blocks) for k in range(n)]
    assert len({r["slot"] for r in rows}) == len(rows)
    for i, n in enumerate(blocks):
        assert [r["rank"] for r in rows if r["at"] == i] == list(range(n))
    for a in range(0, len(rows) - 100, 37):
        some = Counter(r["at"] for r in rows[a : a + 100])
        assert all(abs(some[i] - 100 * n / sum(blocks)) <= 4 for i, n in enumerate(blocks))


def test_mix_blocks(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(700, "a"), (30, "a"), (90, "b"), (5, None), (0, "c")])], "doc_id long, text string, source string")
    blocks, taken = mixing.mix_blocks(docs, block_words=50).collect(), by_id(mixing.mix(docs, block_words=50))
    for i, r in taken.items():
        mine = [b for b in blocks if b["doc_id"] == i]
        assert sum(b["words"] for b in mine) == r["taken"] and min((b["slot"] for b in mine), default=None) == r["first_slot"]
        assert all(0 <= b["start"] and b["start"] + b["words"] <= r["size"] for b in mine)
    per_slot = Counter()
    for b in blocks:
        per_slot[b["slot"]] += b["words"]
    assert max(per_slot.values()) <= 50


def test_substring(docs, empty):
    out, first = by_id(substring.remove_repeats(docs)), {}
    for i, t in enumerate(TEXTS):
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (out[i]["n_words"], out[i]["n_removed"], out[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert out[1]["n_removed"] == 120 and out[9]["n_removed"] == 70
    assert substring.remove_repeats(empty).collect() == []


def test_substring_on_shared_passages(spark, monkeypatch):
    """Passages in other surroundings, again in one document, in hot groups, and in several segments of a small sketch."""
    rng = np.random.default_rng(4)
    shared, texts = [prose(700 + i, 70).split() for i in range(4)], []
    for i in range(60):
        w = prose(800 + i, int(rng.integers(0, 60))).split()
        for _ in range(int(rng.integers(0, 4))):
            k, a = int(rng.integers(4)), int(rng.integers(0, 15))
            w += shared[k][a : int(rng.integers(a + 40, 71))] + prose(900 + i, int(rng.integers(0, 9))).split()
        texts.append(" ".join(w))
    texts += ["z " * 400, "z " * 260, texts[3]]
    for bits in (16, 5):
        monkeypatch.setattr(substring.repeated_windows, "__defaults__", (bits, 3))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        out, first = by_id(substring.remove_repeats(df)), {}
        for i, t in enumerate(texts):
            w, gone = t.encode().split(), set()
            for k in range(len(w) - 49):
                if first.setdefault(tuple(w[k : k + 50]), i) < i:
                    gone.update(range(k, k + 50))
            assert (out[i]["n_words"], out[i]["n_removed"]) == (len(w), len(gone))
            assert out[i]["kept_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


def test_sketch_lets_few_single_anchors_through(spark):
    """Whatever the input: the sketch has as many segments as the runs ask for."""
    for n in (20, 200):
        rows = spark.createDataFrame([(i, i, prose(2000 + i, 200)) for i in range(n)], "_doc long, _hash long, _text string")
        runs = n * 12
        segments = -(-runs >> 5)
        kept = substring.estimated_repeated(rows, 50, substring.count_min(rows, 50, segments, 6), segments, 6)
        assert segments > 1 and kept.count() < 0.12 * runs


def test_quality(docs, empty):
    out = by_id(quality.judge_quality(docs))
    for i, t in enumerate(TEXTS):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and (not r["base_failed"] or not r["kept"])
    assert quality.judge_quality(empty).collect() == []


def test_licenses(spark, empty):
    df = spark.createDataFrame([(1, "x y\nLicensed under the APACHE license version 2.0. tail"), (2, None), (3, ""), (4, "nothing here at all"), (5, "All rights reserved. " * 2)], "doc_id long, text string")
    got = [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(df).orderBy("doc_id", "start").collect()]
    assert got == [(1, "Apache-2.0"), (5, "all-rights-reserved"), (5, "all-rights-reserved")]
    assert licenses.scan_licenses(empty).collect() == []


def test_licenses_with_inserted_words(spark):
    """Words put into or changed in a notice, against every passage of the allowed length."""
    rng, bank, texts = np.random.default_rng(11), licenses.Templates(licenses.LICENSES), []
    for name, notice in licenses.LICENSES.items():
        for inserted in range(8):
            w = notice.split()
            at = int(rng.integers(1, len(w)))
            w[at:at] = prose(500 + inserted, inserted).split() if inserted else []
            if inserted % 3 == 2:
                w[int(rng.integers(len(w)))] = "changed"
            texts.append((name, " ".join([prose(600, 40), *w, prose(601, 9), *w[:3], prose(602, 30)])))
    expected = set()
    for i, (_, t) in enumerate(texts):
        _, h = licenses._words(t)
        for name, notice in licenses.LICENSES.items():
            _, n = licenses._words(notice)
            k = min(5, len(n))
            gram = lambda x: [tuple(x[a : a + k]) for a in range(len(x) - k + 1)]
            mine, g, width = set(gram(n)), gram(h), -(-len(n) * 5 // 4) - k + 1
            best = max(len(mine.intersection(g[a : a + width])) for a in range(len(g)))
            if 5 * best >= 4 * len(mine):
                expected.add((i, name, round(best / len(mine), 9)))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = [(r["doc_id"], r["license"], round(r["containment"], 9)) for r in licenses.scan_licenses(df).collect()]
    assert set(got) == expected
    # By hand: three words in the middle of 30 leave 22 of 26 shingles.
    w = licenses.LICENSES["Apache-2.0-notice"].split()
    (hit,) = [x for x in bank.find(" ".join(["x y", *w[:15], "one two three", *w[15:], "z"])) if x[0] == "Apache-2.0-notice"]
    assert (hit[1], round(26 * hit[3])) == (4, 22)
    twice = " ".join([*w, *w])
    assert [(x[1], x[3]) for x in bank.find(twice) if x[0] == "Apache-2.0-notice"] == [(0, 1.0), (len(" ".join(w)) + 1, 1.0)]


def test_licenses_in_long_and_repeated_texts():
    bank = licenses.Templates(licenses.LICENSES)
    hits = bank.find("All rights reserved. " * 20_000)
    assert len(hits) == 20_000 and {x[0] for x in hits} == {"all-rights-reserved"}
    text = " ".join([prose(31, 3000), licenses.LICENSES["MIT-text"], prose(32, 3000), licenses.LICENSES["MIT-text"].replace("AUTHORS", "WRITERS").replace("limitation", "limit"), prose(33, 50)] * 5)
    found = [x for x in bank.find(text) if x[0] == "MIT-text"]
    assert [round(x[3], 2) for x in found] == [1.0, 0.94] * 5
    assert all(text[x[1] :].startswith("Permission is hereby granted") for x in found)


def test_windows_of_random_notices():
    """Band retrieval and passages against every window of random texts over few words."""
    rng, letters = np.random.default_rng(12), list("abcdefgh")
    for _ in range(150):
        notice = rng.choice(letters, rng.integers(2, 14)).tolist()
        bank = licenses.Templates({"n": " ".join(notice)})
        (t,) = bank.items
        text = rng.choice(letters, rng.integers(0, 30)).tolist()
        for _ in range(rng.integers(0, 3)):
            part = list(notice)
            if rng.random() < 0.5:
                part[int(rng.integers(len(part)))] = "x"
            at = int(rng.integers(len(text) + 1))
            text[at:at] = part
        mine, g = set(t.order.tolist()), licenses.grams(licenses._words(" ".join(text))[1], t.words).tolist() if len(text) >= t.words else []
        best = max((len(mine.intersection(g[a : a + t.width])) for a in range(len(g))), default=0)
        got = [x[3] for x in bank.find(" ".join(text))]
        assert bool(got) == (best >= t.need) and (not got or round(max(got) * len(mine)) == best), (notice, text)


def test_marginals_match_enumeration():
    m = toxicity.Crf(trans=np.array([[0.4, -0.3], [-0.5, 0.9]]), bias=-0.7)
    score, n = {1: 1.3, 4: 2.0, 5: -0.4}, 8
    total, hit = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [(code >> k) & 1 for k in range(n)]
        w = np.exp(sum(m.trans[y[k - 1], y[k]] for k in range(1, n)) + sum(y[k] * (m.bias + score.get(k, 0)) for k in range(n)))
        total += w
        hit += w * np.array(y)
    at = np.array(sorted(score))
    assert np.allclose(m.marginals(at, np.array([score[k] for k in at]), n), (hit / total)[at])


def test_gradient_matches_differences():
    rng = np.random.default_rng(8)
    feats = rng.integers(0, 6, (4, 7, toxicity.SLOTS))
    labels, lengths, theta = rng.integers(0, 2, (4, 7)), np.array([7, 1, 4, 6]), rng.normal(0, 0.5, 6 + 5)
    labels[np.arange(7)[None, :] >= lengths[:, None]] = 0
    theta[0] = 0.0
    at, grad = toxicity.chain_gradient(theta, feats, labels, lengths)
    assert at < 0
    for k in range(1, len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-5
        up, down = (toxicity.chain_gradient(theta + d, feats, labels, lengths)[0] for d in (step, -step))
        assert abs((up - down) / 2e-5 - grad[k]) < 1e-5


def test_toxicity(spark, empty):
    rng = np.random.default_rng(3)
    texts = [prose(100 + i, 40).split() for i in range(200)]
    for i in range(0, 200, 4):
        for k in rng.choice(40, 3, replace=False):
            texts[i][k] = str(rng.choice(["vile", "nasty", "Foul!"]))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = by_id(toxicity.score(docs, model, ["doc_id"]))
    assert sum(out[i]["predicted"] != int(i % 4 == 0) for i in range(200)) <= 2
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[900]["predicted"] == 0
    assert {texts[0][k] for k in range(40)} & {"vile", "nasty", "Foul!"} and out[0]["spans"]
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0)), ["doc_id"]).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = prose(77, 60)
    rows = [(i, prose(200 + i, 50), "en", f"s{i % 3}", 0) for i in range(12)] + [(20, base, "en", "s0", 0), (21, base + " end", "en", "s1", 0), (22, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "near-duplicates":
            assert kept == {*range(12), 20, 22}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns


def test_one_of_each_group_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    a, b, c, d = (prose(400 + i, 60) for i in range(4))
    rows = [(None, a), (None, b), (None, b + " end"), (7, c), (7, d), (None, c + " end"), (8, d + " end"), (9, a + " end"), (9, a + " end"), (None, None), (None, None), (None, " "), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    bare = [x for x in rows if not (x[1] or "").strip()]
    assert sorted(map(str, got)) in [sorted(map(str, [(9, a + " end"), x, (7, c), (7, d), *bare])) for x in rows[1:3]]
    judged = minhash.near_duplicates(docs).collect()
    assert sorted((r["component_id"], r["kept"]) for r in judged if r["doc_id"] is None and r["component_id"]) == [(7, False), (9, False)]
