"""Per-document operators against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tallyloom.llm")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from tallyloom.llm import bpe, langid, pii, quality  # noqa: E402
from tallyloom.llm.textbatch import blocks  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor " * 20_000


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, l, "s", None) for i, t, l in rows], DOCS)
    return df.selectExpr("*", "1 AS _k", "2 AS key", "'x' AS label") if extra else df


def test_bpe_equals_library():
    coder = bpe.codec(PATH, PATTERN)
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    r = random.Random(3)
    texts = ["".join(r.choice("aabbee  \n'st1é漢\x00") for _ in range(r.randrange(60))) for _ in range(3000)]
    for t in [*texts, "", "a" * 20_000, "ab" * 5_000, " " * 900, "<|endoftext|>", "the" * 3_000]:
        ids = coder.encode(t)
        assert ids == known.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_bpe_cache_is_bounded():
    small = bpe.Codec(bpe.load_ranks(PATH), PATTERN, cache=4)
    text = "one two three four five six seven eight nine ten one two three"
    assert small.encode(text) == bpe.codec(PATH, PATTERN).encode(text) and len(small.young) <= 4 and len(small.old) <= 4


def test_bpe_columns(spark):
    docs = frame(spark, [(1, "Hello there", "en"), (2, None, "en"), (2, "", None), (3, LONG, "en")], extra=True)
    coded = bpe.encode_column(docs, PATH, PATTERN)
    back = bpe.decode_column(coded, PATH, PATTERN)
    assert sorted(bytes(r["decoded"]).decode() for r in back.collect()) == sorted(["Hello there", "", "", LONG])
    digest = {r["doc_id"]: r for r in bpe.round_trip_digest(docs, PATH, PATTERN).where("doc_id <> 2").collect()}
    assert digest[3]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest() and digest[1]["n_tokens"] == 2
    assert bpe.round_trip_digest(docs.limit(0), PATH, PATTERN).count() == 0


def plain_spans(t):
    kinds = [
        (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True), (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
        (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))), (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m[0]))


def test_fixed_patterns():
    r = random.Random(5)
    parts = ["1", "2.", ".", "@", "a", "-", "+", "(", " ", "255", "4111111111111111", "4111-1111-1111-1111", ".com", "é", "+1 (555) 123-4567", "\n"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(16)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("1" * 100_000) == [] and pii.base_spans("a" * 100_000) == [] and pii.base_spans("1." * 50_000)


def test_contexts_find_identifiers(spark):
    rows = [(i, f"some words here\nmember card: user{i}@mail.example.com and more text", "en") for i in range(30)]
    rows += [(100 + i, f"other words\nmember card: ZX-{i}77Q9 follows", "en") for i in range(5)]
    rows += [(200, "clean text of 4.0 and 1234 words", "en"), (201, None, "en"), (202, "", "en"), (203, "member card: nothing here", "en")]
    docs = frame(spark, rows, extra=True)
    patterns = pii.learn_patterns(docs)
    got = {r["doc_id"]: r for r in pii.find(docs, patterns).collect()}
    assert all(got[100 + i]["n_id"] == 1 for i in range(5)) and all(got[i]["n_email"] == 1 and got[i]["n_id"] == 0 for i in range(30))
    assert all(got[i]["spans"] == "" for i in (200, 201, 202, 203))
    text = rows[31][1]
    assert got[101]["spans"] == f"id:{text.index('ZX')}:{text.index(' follows')}"
    clean = {r["doc_id"]: r for r in pii.redact(docs, patterns).collect()}
    assert "[ID] follows" in clean[101]["text"] and "[EMAIL] and" in clean[3]["text"] and clean[201]["text"] is None and clean[200]["text"] == rows[35][1]
    assert pii.redact(docs, patterns).columns == docs.columns
    assert len(pii.learn_patterns(docs.limit(0))) == 0


def test_redaction_of_overlaps():
    assert pii.redact_text("ab cd ef", [(0, 0, 5), (3, 2, 8)]) == "[EMAIL]"
    assert pii.redact_text("x 1.1.1.1 y", [(2, 1, 9)]) == "x [IP] y"


WORDS = {"en": "the of and with this that from here", "de": "der die und nicht über schön für zu", "fr": "le les être où français avec été une"}


def speech(lang, r, n=40):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def test_language(spark):
    r = random.Random(1)
    rows = [(i, speech(lang, r), lang) for i, lang in enumerate(list(WORDS) * 40)]
    model = langid.fit(frame(spark, rows))
    assert model.langs == ["de", "en", "fr"]
    tests = [(1, speech("de", r), None), (2, speech("en", r), None), (3, None, None), (4, "", None), (5, "12 34 !!", "en"), (6, "ü", None), (7, speech("fr", r, 40_000), None)]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(frame(spark, tests, extra=True), model).collect()}
    assert [got[i][0] for i in (1, 2, 7)] == ["de", "en", "fr"] and [got[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3 and got[6][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = langid.fit(frame(spark, rows).limit(0))
    assert langid.predict(frame(spark, tests), empty).where("lang_pred <> 'und'").count() == 0


def test_language_against_plain_bayes(spark):
    """The same rule over dictionaries: hashed n-grams only differ where they collide."""
    r = random.Random(3)
    rows = [(i, speech(lang, r, 25), lang) for i, lang in enumerate(["en"] * 30 + ["de"] * 20 + ["fr"] * 10)] + [(None, "zz zz", "xx"), (90, None, "en"), (91, "text", None)]
    grams = lambda t: [t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)]
    counts = {lang: Counter(g for i, t, x in rows if x == lang and t and i is not None for g in grams(t.lower())) for lang in ("de", "en", "fr")}
    named = Counter(x for i, t, x in rows if x and t and i is not None)
    size = {x: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for x, c in counts.items()}

    def plain(t):
        logs = {x: math.log(named[x] / sum(named.values())) + sum(math.log((c[g] + langid.SMOOTHING) / size[x]) for g in grams(t.lower())) for x, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())

    tests = [(100 + i, speech(r.choice(list(WORDS)), r, r.randrange(1, 4)), None) for i in range(60)]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(frame(spark, tests), langid.fit(frame(spark, rows))).collect()}
    for i, t, _ in tests:
        want = plain(t)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 0.02, t


def test_languages_of_held_out_documents(spark):
    from tallyloom.llm import queries

    got = queries.op7_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out AND lang_pred <> 'und'").join(docs, "doc_id").where("lang IS NOT NULL").toPandas()
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.98


def plain_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    found = {}
    for i in range(len(w) - 4):
        found.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for v in found.values() if len(v) > 1 for i in v for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(spark):
    r = random.Random(2)
    good = [(i, speech("en", r) + ".", "en") for i in range(80)]
    bad = [(100 + i, speech("en", r).upper().replace(" ", "!! ") + " ###", "en") for i in range(80)]
    odd = [(300, None, "en"), (301, "", "en"), (302, "a b c d e f a b c d e f", "en"), (303, "x\n\nx\n \n \nx\t\r\n", "en"), (304, LONG, "en"), (305, "é漢 ## \n" * 4, "en"), (306, "\n", "en")]
    docs = frame(spark, good + bad + odd, extra=True)
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad] + [(None, 1, 0), (1, None, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = {x["doc_id"]: x for x in quality.score(docs, model).collect()}
    for i, t, _ in good + bad + odd:
        x = rows[i]
        n = plain_stats(t or "")
        assert tuple(x[k] for k in quality.STATS) == n, t
        assert x["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    assert sum(rows[i]["kept"] for i, *_ in good) >= 70 and not any(rows[i]["kept"] for i, *_ in bad)
    weights = model.weights.astype(float)  # the score by hand
    for t in (good[3][1], bad[3][1], odd[5][1]):
        word = [xx for xx in re.findall(r"[^\x20\x09-\x0D]+", t)]
        one = lambda x: int(quality.block_stats(next(blocks(pa.array([x]))))["word_hash"][0] % np.uint64(quality.BUCKETS))
        whole = next(blocks(pa.array([t])))
        prefix = whole.prefix_hash()
        cut = lambda a, b: int(whole.span_hash(prefix, np.array([len(t[:a].encode())]), np.array([len(t[:b].encode())]))[0] % np.uint64(quality.BUCKETS))
        score = np.mean([weights[one(x)] for x in word]) + np.mean([weights[quality.BUCKETS + cut(i, i + 3)] for i in range(len(t) - 2)]) + model.bias
        i = next(i for i, x, _ in good + bad + odd if x == t)
        assert abs(rows[i]["probability"] - 1 / (1 + math.exp(-(model.scale * score + model.shift)))) < 1e-4
        assert rows[i]["kept"] == (not rows[i]["base_failed"] and rows[i]["probability"] >= quality.KEEP_FROM)
    both = labels.unionByName(spark.createDataFrame([(0, 0, 0)], labels.schema))  # both ways: as if not labelled
    again, without = quality.fit(docs.unionByName(docs.where("doc_id = 1")), both), quality.fit(docs, labels.where("doc_id <> 0"))
    assert np.array_equal(again.weights, without.weights) and again.scale == without.scale
    assert {x["doc_id"] for x in quality.filter_good(docs, model).collect()} == {i for i, x in rows.items() if x["kept"]}
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.score(docs.limit(0), None).count() == 0


@pytest.mark.parametrize("most", [10_000, 0])
def test_rare_contexts_are_learned(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "MOST", most)
    rows = [(i, f"write to: x@mail.example.com {i % 7}", "en") for i in range(40_000)]
    rows += [(50_000 + i, f"member card: user{i}@mail.example.com and", "en") for i in range(5)] + [(60_000 + i, f"member card: ZX-{i}77Q9 follows", "en") for i in range(3)]
    docs = frame(spark, rows + [(70_000, None, "en")], extra=True)
    patterns = pii.learn_patterns(docs)
    got = {r["doc_id"]: (r["n_id"], r["n_email"]) for r in pii.find(docs, patterns).collect()}
    assert [got[60_000 + i] for i in range(3)] == [(1, 0)] * 3 and got[5] == got[50_001] == (0, 1) and len(got) == len(rows) + 1
    clean = pii.redact(docs.where("doc_id >= 60000"), patterns)
    assert clean.columns == docs.columns and sorted(r["text"] or "" for r in clean.collect()) == ["", *["member card: [ID] follows"] * 3]


def plain_scores(edges):
    """edges: {pattern: {value: seed}}."""
    edges = {p: v for p, v in edges.items() if len(v) >= pii.SUPPORT}
    seeds = {v: s for own in edges.values() for v, s in own.items()}
    sure = {v: float(s) for v, s in seeds.items()}
    for _ in range(pii.ROUNDS):
        scores = {p: sum(sure[v] for v in own) / (len(own) + 1) for p, own in edges.items() if sum(sure[v] >= pii.ACCEPT for v in own) >= pii.SUPPORT}
        sure = {v: max([float(s), *(scores[p] for p, own in edges.items() if v in own and p in scores)]) for v, s in seeds.items()}
    return scores


def test_scores_of_patterns(spark):
    r = random.Random(17)
    kinds = {v: v < 40 for v in range(120)}
    edges = {p: {v: kinds[v] for v in r.sample(range(120), r.randrange(1, 12))} for p in range(80)}
    edges[900] = {v: True for v in range(12)}
    df = spark.createDataFrame([(p, v, s) for p, own in edges.items() for v, s in own.items()], "pattern bigint, value bigint, seed boolean")
    got = {x["pattern"]: x["p"] for x in pii.score(df).collect()}
    want = plain_scores(edges)
    assert got.keys() == want.keys() and len(got) > 5 and all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_found_instances_seed_the_next_round(spark):
    """`badge no` stands before words that no seed looks like; only what follows some of
    them is known from the seeds."""
    after = ["signed", "sealed", "posted", "copied"]
    rows = [(i, f"plain words {i % 9} times from u{i}x@mail.example.com {after[i % 4]} today", "en") for i in range(60)]
    rows += [(100 + i, f"some badge no: K{i}Z{i * 7}W {after[i % 4] if i % 3 else 'then'} more{'abcdefgh'[i % 8]}", "en") for i in range(24)]
    rows += [(200 + i, f"chapter {1000 + i} of the long book{'abc'[i % 3]}", "en") for i in range(30)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["n_id"] for r in pii.find(docs, pii.learn_patterns(docs)).collect()}
    assert all(got[100 + i] == 1 for i in range(24)) and all(got[200 + i] == 0 for i in range(30)) and all(got[i] == 0 for i in range(60))


def test_identifiers_of_an_unseen_kind_in_documents(spark):
    """Tokens of 40 hexadecimal digits match no fixed pattern; nothing in the code names them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs, pii.learn_patterns(docs)).collect()}
    want, found, good = 0, 0, 0
    for r in docs.where("text IS NOT NULL").collect():
        ids = {(int(a), int(b)) for a, b in re.findall(r"id:(\d+):(\d+)", spans[r["doc_id"]])}
        hidden = {m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})', r["text"], re.I)}
        want, found = want + len(hidden), found + len(hidden & ids)
        # The others are numbers as long as those of cards.
        good += sum(1 for a, b in ids if (a, b) in hidden or re.fullmatch("[0-9]{13,19}", r["text"][a:b]))
    total = sum(s.count("id:") for s in spans.values())
    assert want > 100 and found >= 0.9 * want and good >= 0.95 * total
