"""Toxicity, personal data and language: held-out accuracy, rules against brute force, odd rows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwatch.llm import langid, pii, toxicity

SF = "/root/testdata/sf0.1"


def odd(spark):
    return spark.createDataFrame([(1, None, "en", 9.0), (2, "", None, 9.0), (None, "the words of it", "en", 9.0), (3, "123 !!", "de", 9.0), (3, "123 !!", "de", 9.0), (4, "trash " * 20000, "en", 9.0)], "doc_id long, text string, lang string, score double")


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    r = toxicity.op1_toxicity(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((r.predicted == 1) & (r.toxic == 1)).sum()
    assert hit / (r.toxic == 1).sum() > 0.85 and hit / (r.predicted == 1).sum() > 0.9 and r.score.between(0, 1).all()


def test_toxicity_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(4, 1), (1, 0), (9, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, model)
    assert out.count() == 6 and out.where("score BETWEEN 0 AND 1").count() == 6 and out.columns == ["doc_id", "text", "lang", "score", "predicted"]
    nothing = toxicity.train_toxicity(docs.limit(0), labels.limit(0))
    assert toxicity.drop_toxic(docs, nothing).count() == 6 and toxicity.score_toxicity(docs.limit(0), nothing).count() == 0


def test_negative_risk_is_held_up():
    rng = np.random.default_rng(0)
    xp = (rng.random((80, 20)) < 0.3).astype(np.float32)
    xp[:, 0] = 1
    xu = (rng.random((400, 20)) < 0.3).astype(np.float32)
    xu[:, 0] = rng.random(400) < 0.2
    w, b = toxicity.nn_pu_fit(xp, xu, 0.2)
    assert ((xu @ w + b > 0) == (xu[:, 0] == 1)).mean() > 0.95


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = langid.op10_langid(spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.99 and r.score.between(0, 1).all()


def test_language_odd_rows(spark):
    docs = odd(spark)
    model = langid.fit_ecoc([langid.ngram_counts(t) for t in ("the of and", "der die das und", "les des une")], ["en", "de", "fr"])
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify_language(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(langid.identify_language(docs, model).columns) == 6
    assert langid.train_langid(docs.limit(0)).langs == [] and {r["lang_pred"] for r in langid.identify_language(docs, langid.EcocModel()).collect()} == {"und"}


def test_language_sample_is_bounded_and_decoding_is_brute_force(spark):
    words = {"en": "the of and to", "de": "der die das und", "fr": "les des une et"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split()).tolist() * 3), lang) for i in range(200) for lang, t in words.items()] + [(1, words["en"], "en")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = langid.fit_ecoc
    try:
        langid.fit_ecoc = lambda counts, langs, bits: (seen.append((len(counts), {x: langs.count(x) for x in langs})), real(counts, langs, bits))[1]
        model = langid.train_langid(docs, per_lang=50, max_rows=90)
    finally:
        langid.fit_ecoc = real
    assert seen == [(90, {"de": 30, "en": 30, "fr": 30})]
    got = langid.identify_language(docs.dropDuplicates(), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    for r in got[:60]:
        margins = langid.profile(langid.ngram_counts(r["text"])) @ model.weights + model.bias
        loss = [sum(w * np.log1p(np.exp(-m * c)) for m, c, w in zip(margins, word, model.reliability, strict=True)) for word in model.code.tolist()]
        assert model.langs[int(np.argmin(loss))] == r["lang_pred"]


def test_codewords_differ():
    for n in (2, 4, 9):
        c = langid.codewords(n, 15)
        assert len({tuple(x) for x in c.tolist()}) == n and (np.abs(c.sum(axis=0)) < n).all()


def brute_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+- 0%(4é", max_size=60))
def test_base_spans(t):
    assert pii.base_spans(t) == brute_spans(t)


def test_base_spans_sql():
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = duckdb.sql(pii.BASE_SQL.replace("FROM documents", "FROM '/root/testdata/sf0.01/documents.parquet'")).fetchall()
    want = []
    for d, t in rows:
        spans = pii.base_spans(t or "")
        want.append((d, *(sum(k == i for k, _, _ in spans) for i in range(4)), hashlib.sha256(pii.spans_text(spans).encode()).hexdigest()))
    assert sorted(got) == sorted(want) and sum(sum(r[1:5]) for r in want) > 50


@pytest.mark.parametrize("n", ["4111111111111111", "4111 1111 1111 1111", "41111111111111112", "0000000000000"])
def test_cards(n):
    assert pii.base_spans(f"x {n} y") == brute_spans(f"x {n} y")


def test_long_runs_are_fast():
    import time

    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 100_000, "+1(" * 100_000, "a@" * 100_000):
        at = time.time()
        base = pii.base_spans(t)
        pii.candidates(t, base)
        assert time.time() - at < 5


def planted(seed, n):
    """Documents with personal data and look-alikes of every added kind: (text, spans that are personal data)."""
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    key = lambda k: "".join(rng.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    given, family = sorted(pii.GIVEN), ["Marlow", "Hartley", "Okafor", "Lindqvist", "Berger", "Moreau", "Castell", "Whitby"]
    strange = ["Torvik", "Maelle", "Zuberi", "Ansgar", "Ilse", "Yusra"]

    def account():
        body = "GB" + digits(0) + "00" + "ABCD" + digits(14)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        return f"GB{check:02d}{body[4:]}"

    right = [
        lambda: ("secret", 'token = "', hexes(40), '"'), lambda: ("secret", "api_key: ", key(32), "\n"), lambda: ("secret", "the password is ", key(20), " now"), lambda: ("secret", "Authorization: Bearer ", "sk-" + key(28), "\n"),
        lambda: ("number", "her SSN: ", f"{digits(3)}-{digits(2)}-{digits(4)}", "."), lambda: ("number", "account ", account(), " please"), lambda: ("number", "passport no. ", digits(9), ","), lambda: ("number", "IBAN: ", account(), "\n"),
        lambda: ("name", "we met Dr. ", f"{rng.choice(given)} {rng.choice(family)}", " said so"), lambda: ("name", "please write, ", f"{rng.choice(given)} {rng.choice(family)}", " lives there"),
        lambda: ("name", "her name is ", f"{rng.choice(strange)} {rng.choice(family)}", "."), lambda: ("name", "yours, signed ", f"{rng.choice(given)} {rng.choice(family)}", "\n"),
    ]
    wrong = [
        lambda: ("commit ", hexes(40), " fixed it"), lambda: ("sha256: ", hexes(64), "\n"), lambda: ("the uuid ", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", " again"), lambda: ("see the file a1/usr/share/", "some/long-path/part2", " there"),
        lambda: ("order ", digits(12), " is late"), lambda: ("about ", digits(9), " people"), lambda: ("build ", digits(10), " of it"), lambda: ("isbn ", digits(13), " here"),
        lambda: ("we walked along ", "Castle Street", " today"), lambda: ("it is in ", "New Haven", " now"), lambda: ("\n", "The Chapter Heading", "\n"), lambda: ("ends here. ", "This Section", " is over"),
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 6)):
            text += " ".join(rng.choice(["one", "word", "after", "more", "still"]) for _ in range(rng.randint(4, 12))) + " "
            if rng.random() < 0.5:
                kind, before, value, after = rng.choice(right)()
                spans.append((kind, len(text + before), len(text + before + value)))
                text += before + value + after + " "
            else:
                text += "".join(rng.choice(wrong)()) + " "
        out.append((text, spans))
    return out


def test_planted_spans_are_found_and_look_alikes_are_not():
    """Fitted on the votes of one corpus, read on another: precision and recall per kind, and both decisions within every kind."""

    def proposed(text):
        base = pii.base_spans(text)
        return [(k, s, e, pii.features(text, k, s, e, base)) for k, s, e in pii.candidates(text, base)]

    counts = Counter((k, b) for text, _ in planted(1, 1500) for k, _, _, b in proposed(text))
    model = pii.fit_spans([(k, b, n) for (k, b), n in counts.items()])
    found, wanted, decisions = Counter(), Counter(), {}
    hits = Counter()
    for text, spans in planted(2, 1500):
        want = set(spans)
        wanted.update(k for k, _, _ in spans)
        for k, s, e, b in proposed(text):
            yes = model.accepts(k, b)
            decisions.setdefault(k, set()).add(yes)
            if yes:
                found[pii.KINDS[k]] += 1
                hits[pii.KINDS[k]] += (pii.KINDS[k], s, e) in want
    assert all(d == {True, False} for d in decisions.values())
    for kind in pii.ADDED_KINDS:
        assert hits[kind] / wanted[kind] >= 0.9 and hits[kind] / found[kind] >= 0.9, (kind, hits[kind], found[kind], wanted[kind])


def test_estimation_finds_the_reliable_labelers():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.3
    rates = [(0.9, 0.05), (0.7, 0.1), (0.6, 0.5)]  # says yes if right, if wrong
    v = np.stack([np.where(rng.random(len(truth)) < np.where(truth, a, b), 1, -1) for a, b in rates] + [np.zeros(len(truth), dtype=int)], axis=1)
    kinds, n = np.unique(v, axis=0, return_counts=True)
    p, rate = pii.posterior(kinds, n.astype(float), rounds=400)
    for j, (a, b) in enumerate(rates):
        assert abs(rate[1, j, 2] - a) < 0.08 and abs(rate[0, j, 2] - b) < 0.08
    assert abs((p * n).sum() / n.sum() - 0.3) < 0.05


def test_secrets_of_the_corpus_are_found(spark):
    """Every quoted token of the test data, and no number that is no card."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pii.op8_pii(spark, SF).select("doc_id", "n_secret", "n_number", "n_name").join(docs.select("doc_id", "text"), "doc_id").toPandas()
    want = got.text.fillna("").map(lambda t: len(re.findall(r'(?i)token = "[0-9a-f]{40}"', t)))
    assert (got.n_secret == want).all() and want.sum() > 100 and got.n_number.sum() == 0 and (got.n_name > 0).mean() < 0.001


def test_personal_data(spark):
    rows = [(1, None), (2, ""), (3, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" x@y.org'), (3, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" x@y.org'), (None, "+1 (487) 555-7209 at 10.0.0.1"), (5, "plain words only")] * 3
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string")
    got = pii.find_personal_data(docs).collect()
    assert len(got) == 18 and {r["spans"] for r in got if r["doc_id"] == 3} == {"email:51:58,secret:9:49"}
    assert {(r["n_phone"], r["n_ip"]) for r in got if r["doc_id"] is None} == {(1, 1)} and {r["base"] for r in got if r["doc_id"] in (1, 2, 5)} == {""}
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    text = dict(rows)[3]
    assert hashlib.sha256(pii.spans_text(brute_spans(text)).encode()).hexdigest() == hashlib.sha256([r["base"] for r in got if r["doc_id"] == 3][0].encode()).hexdigest()
