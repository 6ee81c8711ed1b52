"""Language ID, toxicity, quality rules, pseudonyms and byte-level BPE against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bizlens.llm import bpe, langid, mixing, pii, quality, toxicity
from bizlens.llm.common import held_out
from bizlens.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.compare import compare, duck, type_diff
from tests.conftest import SF_ORACLE, SF_SMALL

WORD = r"[^\x20\x09-\x0D]+"
LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "é🙂 | # \x0b b\n"), (5, "a b c a b c"), (6, LONG), (6, LONG), (None, "a a a a")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a long text, repeated rows and extra columns named like results."""
    return spark.createDataFrame(ODD, "doc_id bigint, text string").withColumn("size", F.lit("x")).withColumn("kept", F.lit(1))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    df, con = QUERIES[name](spark, SF_ORACLE), duck(SF_ORACLE)
    ok, message = compare(df, con, ORACLE_SQL[name])
    assert ok, message
    assert type_diff(df, con, ORACLE_SQL[name]) == {}


# ---- language ID

def path_value(scores, path, switch):
    return sum(scores[i, p] for i, p in enumerate(path)) - switch * sum(path[1:] != path[:-1])


def plain_viterbi(scores, switch):
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        change = best.max() - switch
        back.append(np.where(best >= change, np.arange(len(best)), best.argmax()))
        best = np.maximum(best, change) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def test_viterbi_of_segments_is_the_plain_one():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths, k = rng.integers(1, 40, rng.integers(1, 6)), int(rng.integers(1, 5))
        scores = rng.normal(size=(lengths.sum(), k)).astype(np.float32)
        got = langid.viterbi(scores, np.repeat(np.arange(len(lengths)), lengths), 1.5, 4)
        for a, b in zip(np.cumsum(lengths) - lengths, np.cumsum(lengths)):
            assert path_value(scores[a:b], got[a:b], 1.5) == pytest.approx(
                path_value(scores[a:b], plain_viterbi(scores[a:b], 1.5), 1.5), abs=1e-3)


def test_languages_of_the_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    rows = QUERIES["op1_langid"](spark, SF_ORACLE).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_scripts_and_odd_texts(spark, odd):
    train = spark.createDataFrame(
        [(i, "the cat and the dog were here with that thing", "en") for i in range(30)]
        + [(i, "der hund und die katze waren nicht hier mit dem ding", "de") for i in range(30)]
        + [(i, "кошка и собака были здесь", "ru") for i in range(30)] + [(1, None, "en"), (2, "x", None)],
        "doc_id bigint, text string, lang string")
    model = langid.train(train)
    assert model.langs == ["de", "en", "ru"]
    mixed = "the cat and the dog were here der hund und die katze waren nicht собака здесь"
    (row,) = langid.identify(spark.createDataFrame([(1, mixed)], "doc_id bigint, text string"), model, with_spans=True).collect()
    assert [s.lang for s in row.spans] == ["en", "de", "ru"]
    assert mixed[row.spans[2].start:row.spans[2].end] == "собака здесь"
    got = langid.identify(odd, model).collect()
    assert [(r.lang_pred, r.score) for r in got][:3] == [("und", 0.0)] * 3 and len(got) == len(ODD)
    none = langid.train(train.where("false"))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.where("false"), model).count() == 0


# ---- toxicity

def test_toxicity_of_planted_words(spark):
    clean, bad = "the quiet river runs along a green valley", "you are a zorkish fool of the valley"
    rows = [(i, f"{bad if i % 5 == 0 else clean} number {i}", int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 300] + [(7, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in rows)
    assert got[1000] == got[1001] < toxicity.THRESHOLD
    for some in ("toxic = 0", "false"):
        flat = toxicity.train(docs, labels.where(some))
        assert max(r.score for r in toxicity.score(docs, flat).collect()) < 0.01


def test_toxicity_beats_chance_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    r = QUERIES["op7_toxicity"](spark, SF_ORACLE).join(labels, "doc_id").where("held_out").toPandas()
    assert ((r.predicted == 1) & (r.toxic == 0)).sum() <= 5
    ranks, n = r.score.rank()[r.toxic == 1], (r.toxic == 1).sum()
    assert (ranks.sum() - n * (n + 1) / 2) / (n * (len(r) - n)) > 0.8


def drawn_votes(rng, n):
    """Votes of a known model: voter 1 repeats voter 0 nine times in ten, voter 5 repeats 4; the others fire alone."""
    label = rng.random(n) < 0.3
    rate = np.array([[0.05, 0.05, 0.03, 0.08, 0.10, 0.10, 0.02, 0.04], [0.5, 0.5, 0.4, 0.6, 0.3, 0.3, 0.5, 0.45]])
    fires = rng.random((n, 8)) < rate[label.astype(int)]
    for copy, of in ((1, 0), (5, 4)):
        again = rng.random(n) < 0.9
        fires[again, copy] = fires[again, of]
    return label, fires.astype(np.float32), rate


def test_label_model_finds_accuracies_and_correlations_without_labels():
    label, fires, rate = drawn_votes(np.random.default_rng(5), 20_000)
    model, posterior = toxicity.label_model(fires, 0.3, np.clip(rate * [[1.5], [0.7]], 0.01, 0.9))
    true = np.array([label[fires[:, j] > 0].mean() for j in range(8)])
    assert np.abs(model.accuracy - true).max() < 0.05
    links = {frozenset((j, int(p))) for j, p in enumerate(model.partner) if p >= 0}
    assert {frozenset((0, 1)), frozenset((4, 5))} <= links and len(links) <= 3
    assert abs(posterior.mean() - 0.3) < 0.03
    # the chances are right: of rows with a posterior near x about x are toxic
    for low, high in ((0.0, 0.1), (0.3, 0.7), (0.9, 1.0)):
        some = (posterior >= low) & (posterior <= high)
        assert abs(label[some].mean() - posterior[some].mean()) < 0.06
    # the correlation terms decide: without them doubled voices count twice and the log loss is worse
    alone = toxicity.LabelModel(0.3, np.full(8, -1), toxicity.chances(fires, np.full(8, -1), posterior, rate), model.accuracy)
    loss = lambda p: -np.mean(np.where(label, np.log(p), np.log1p(-p)))
    assert loss(posterior) < loss(alone.posterior(fires)) - 0.01


def test_label_model_reads_no_labels_and_takes_odd_votes():
    for fires in (np.zeros((5, 3)), np.ones((5, 3)), np.zeros((1, 1)), np.zeros((4, 0))):
        start = np.full((2, fires.shape[1]), 0.2)
        model, posterior = toxicity.label_model(fires, 0.3, start)
        assert np.isfinite(posterior).all() and len(posterior) == len(fires) and (model.partner < fires.shape[1]).all()


def test_toxicity_of_odd_rows(spark, odd):
    """Long and repeated texts, nulls, an empty table and extra columns."""
    rows = [(i, f"{'a zorkish fool' if i % 4 == 0 else 'a quiet river'} {i}", int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    got = toxicity.score(odd, model)
    assert got.columns == [*odd.columns, "score"] and got.count() == len(ODD)
    scores = {}
    for r in got.collect():
        assert 0 <= r.score <= 1 and scores.setdefault(r.text, r.score) == r.score
    assert toxicity.score(odd.where("false"), model).count() == 0
    clash = toxicity.score(spark.createDataFrame([(1, "a zorkish fool", "s", "t")], "`a.b` int, text string, score string, _text string"), model)
    assert clash.columns == ["a.b", "text", "_text", "score"] and tuple(clash.first())[:3] == (1, "a zorkish fool", "t")
    buried = spark.createDataFrame([(1, LONG + "a zorkish fool")], "doc_id bigint, text string")
    assert toxicity.score(buried, model).first().score >= toxicity.THRESHOLD
    none = toxicity.train(docs.where("false"), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(docs, none).agg({"score": "max"}).first()[0] < 0.01


def test_hashes_of_words_and_features_agree():
    text, hashes = toxicity.word_hashes(["Idiot réeuxle", "", "x" * 200])
    expected = {toxicity.feature_hash(f) for f in ["=idiot", "^idi", "^idio", "=réeuxle", "^rée", "^réeuxl", "=" + "x" * 200]}
    assert expected <= set(hashes.tolist()) and set(text.tolist()) == {0, 2}


# ---- quality rules

def plain_quality(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [s for s in text.split("\n") if re.search(WORD, s)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


def test_quality_counts(spark, odd):
    more = spark.createDataFrame([(20, "a b a b a b a"), (21, "a b c d a b c"), (22, " x\n x\nx \n\n x")],
                                 "doc_id bigint, text string")
    rows = quality.judge(odd, prefix="q_").select("text", *[f"q_{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]).collect() \
        + quality.judge(more).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    for r in rows:
        assert tuple(r)[1:] == plain_quality(r.text), r.text
    assert quality.judge(odd.where("false"), prefix="q_").count() == 0


def test_lines_that_fail_go_and_heavy_losers_are_rejected(spark):
    prose = " ".join(f"Plain{i} sentence{i} number{i} stands{i} here{i}." for i in range(12))
    junk = "\n".join(f"a{i} | b{i} | c{i} | d{i} |" for i in range(40))
    rows = [(1, prose + "\nLicensed under the MIT License."), (2, prose + "\n" + junk), (3, "\n".join([prose] * 2)),
            (4, "WOW!! THIS!! IS!! " + prose)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].kept and got[1].cleaned == prose
    assert not got[2].kept and got[2].cleaned == prose
    assert got[3].n_dup_lines == 1 and not got[3].kept
    assert got[4].kept


# ---- pseudonyms

def luhn(digits):
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def plain_permutation(key, kind, digits):
    """The Feistel network of the operator in Python."""
    n = len(digits)
    a = n // 2
    halves, moduli = [int(digits[:a]), int(digits[a:])], (10 ** a, 10 ** (n - a))
    for i in range(pii.ROUNDS):
        side = i % 2
        value = hashlib.sha256(f"{key}|{kind}|{n}|{i}|{halves[1 - side]}".encode()).hexdigest()[:15]
        halves[side] = (halves[side] + int(value, 16)) % moduli[side]
    return f"{halves[0]:0{a}d}{halves[1]:0{n - a}d}"


def test_pseudonyms_keep_format_validity_and_links(spark, odd):
    text = ("mail bob.34@mail7.example.com card 4417744280351547 or 4111 1111 1111 1111 wrong 9807915762804491 ip 129.38.82.176. "
            "tel +1 (974) 555-3436 iban DE89 3704 0044 0532 0130 00 day 2024-02-29 wrong day 2023-02-30 ssn 123-45-6789 "
            "wrong 000-12-3456 4417744280351547")
    (r,) = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    out = r._pii_text
    for value in ("bob.34@mail7.example.com", "4417744280351547", "4111 1111 1111 1111", "129.38.82.176", "(974) 555-3436",
                  "3704 0044", "2024-02-29", "123-45-6789"):
        assert value not in out
    for value in ("9807915762804491", "2023-02-30", "000-12-3456"):
        assert value in out
    cards = re.findall(r"card (\d{16}) or (\d{4} \d{4} \d{4} \d{4}) ", out)[0]
    assert luhn(cards[0]) and luhn(cards[1].replace(" ", "")) and out.endswith(cards[0])
    payload = plain_permutation(pii.DEFAULT_KEY, "card", "441774428035154")
    assert cards[0][:15] == payload
    iban = re.search(r"iban (DE\d\d(?: \d{4}){4} \d\d) ", out)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert Counter(r._pii_kinds) == Counter(email=1, card=3, ip=1, phone=1, iban=1, date=1, ssn=1)
    got = pii.pseudonymise(odd).collect()
    assert [x._pii_text for x in got] == [t for _, t in ODD] and len(got) == len(ODD)


def pseudonyms_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    return {r.text: (r._pii_text, r._pii_kinds) for r in pii.pseudonymise(rows).collect()}


def test_all_digits_of_long_ibans_are_permuted(spark):
    ibans = ["PL61109010140000071219812874", "HU42117730161111101800000000", "ES9121000418450200051332", "DE89370400440532013000"]
    got = pseudonyms_of(spark, ibans)
    for iban in ibans:
        out, kinds = got[iban]
        assert kinds == ["iban"] and out[4:] == plain_permutation(pii.DEFAULT_KEY, "iban", iban[4:])
        assert int("".join(str(int(c, 36)) for c in out[4:] + out[:4])) % 97 == 1


def test_values_beside_other_numbers_and_capitals(spark):
    card, iban, phone = "4111 1111 1111 1111", "BE68 5390 0754 7034", "+1 974 555 3436"
    beside = {card: ["{}", "{} 12/27", "7 {}", "{} 123", "12 345 {} 99 1234", "NO 5 {} EUR", "2024-02-29 {}", "5-{}-7", "+{}"],
              "4111111111111111": ["{} 123", "1 {} 12", "{} 4111111111111112"],
              iban: ["{}", "{} EUR", "{} 12 EUR", "AB12 {}", "7 {} BIC", "IBAN {} NR 5"],
              "PL61109010140000071219812874": ["{} PLN", "AB12 {} 4"],
              phone: ["{}", "{} 12", "{} 1234", "tel {} 123 4567"]}
    got = pseudonyms_of(spark, [t.format(v) for v, forms in beside.items() for t in forms])
    alone = pseudonyms_of(spark, list(beside))
    for value, forms in beside.items():
        assert alone[value][0] != value
        for form in forms:
            out, kinds = got[form.format(value)]
            if form.startswith("2024"):
                assert out.endswith(alone[value][0]) and kinds == ["date", alone[value][1][0]]
            else:
                assert (out, kinds) == (form.format(alone[value][0]), alone[value][1]), form
    both = f"7 {iban} {card} 12 974-555-3436 123-45-6789"
    out, kinds = pseudonyms_of(spark, [both])[both]
    assert kinds == ["iban", "card", "phone", "ssn"] and out.startswith(f"7 {alone[iban][0]} {alone[card][0]} 12 ")


def test_runs_of_numbers_take_linear_time(spark):
    import time
    rng = np.random.default_rng(5)
    groups = [f"{x:04d}" for x in rng.integers(0, 10_000, 100_000)]
    cards = " ".join(["4111 1111 1111 1111 5500 0000 0000 0004 3782 822463 10005"] * 3_000)
    texts = [" ".join(groups[:10]), " ".join(groups), cards]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    t0 = time.time()
    got = {r.doc_id: (r._pii_text, r._pii_kinds) for r in pii.pseudonymise(rows).collect()}
    assert time.time() - t0 < 90
    alone = pseudonyms_of(spark, ["4111 1111 1111 1111 5500 0000 0000 0004 3782 822463 10005"])
    (out, kinds), = alone.values()
    assert kinds == ["card"] * 3 and got[2] == (" ".join([out] * 3_000), ["card"] * 9_000)
    # an issuer prefix and length (a quarter of all) and a right check digit
    assert len(got[1][1]) < 0.04 * len(groups) and len(got[1][0]) == len(texts[1])


def test_one_pseudonym_for_all_spellings_of_a_telephone_number(spark):
    same = ["+12125551234", "+1 212 555 1234", "+1-212-555-1234", "+1 (212) 555-1234", "+1.212.555.1234"]
    got = pseudonyms_of(spark, [*same, "212-555-1234", "+49301234567", "+49 30 1234567", "+420 601 123 456", "+420601123456"])
    digits = {re.sub(r"\D", "", got[t][0]) for t in same}
    assert len(digits) == 1 and all(got[t][0].startswith("+1") and got[t][1] == ["phone"] for t in same)
    assert "1" + re.sub(r"\D", "", got["212-555-1234"][0]) in digits
    for a, b in (("+49301234567", "+49 30 1234567"), ("+420 601 123 456", "+420601123456")):
        assert re.sub(r"\D", "", got[a][0]) == re.sub(r"\D", "", got[b][0]) != re.sub(r"\D", "", a)
        assert got[a][0][:3] == a[:3]


def test_pseudonyms_beside_any_columns_and_no_rows(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", 7)], "text string, _PII_found int").withColumn("a.b", F.lit(1))
    (r,) = pii.pseudonymise(df).collect()
    assert r["_PII_found"] == 7 and r["a.b"] == 1 and r["_pii_kinds"] == ["card"]
    assert pii.pseudonymise(df.limit(0)).collect() == []


def test_long_secrets_and_more_dates(spark):
    token = "0123456789abcdef" * 8
    texts = [token, token[:70].upper(), token[:64], "at 2024-05-01T10:00:00Z", "2024-5-1", "1.5.2024", "01.05.2024", "5/1/2024",
             "05/01/2024", "25/12/2024", "12/25/2024", "12.25.2024", "2024-12-25", "2024-05-01x", "31/31/2024", "2024-05-01Tue"]
    got = {t: out for t, (out, _) in pseudonyms_of(spark, texts).items()}
    for t in (token, token[:70].upper(), token[:64]):
        assert re.fullmatch(rf"[0-9a-fA-F]{{{len(t)}}}", got[t]) and got[t] != t
        assert (got[t].upper() if t.isupper() else got[t].lower()) == got[t] and not any(t[i:i + 16] in got[t] for i in range(0, len(t) - 15, 16))
    assert got[token][64:] != got[token][:64]
    y, m, d = re.fullmatch(r"at (\d{4})-(\d\d)-(\d\d)T10:00:00Z", got["at 2024-05-01T10:00:00Z"]).groups()
    assert (y, m, d) != ("2024", "05", "01")
    assert got["2024-5-1"] == f"{y}-{int(m)}-{int(d)}" and got["1.5.2024"] == f"{int(d)}.{int(m)}.{y}"
    assert got["01.05.2024"] == f"{d}.{m}.{y}" and got["5/1/2024"] == f"{int(m)}/{int(d)}/{y}" and got["05/01/2024"] == f"{m}/{d}/{y}"
    y, m, d = got["2024-12-25"].split("-")
    assert got["12/25/2024"] == f"{m}/{d}/{y}"
    assert got["25/12/2024"] == (f"{d}/{m}/{y}" if int(d) > 12 else f"{m}/{d}/{y}")
    assert got["12.25.2024"] == (f"{m}.{d}.{y}" if int(d) > 12 else f"{d}.{m}.{y}")
    for t in texts[-3:]:
        assert got[t] == t


def test_digit_permutation_is_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = df.select("d", pii.permute_digits("k", "test", F.col("d")).alias("p")).collect()
    assert len({r.p for r in got}) == 1000 and all(r.p == plain_permutation("k", "test", r.d) for r in got)
    days = spark.range(0, 3000).select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")),
                                                     "yyyy-MM-dd").alias("d"))
    moved = days.select(pii._date("k", F.col("d")).alias("p"))
    assert moved.distinct().count() == 3000
    assert moved.where(~pii._date_ok(F.col("p"))).count() == 0


# ---- BPE

def test_bpe_is_the_tokenizers_library(spark, odd):
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    texts += ["a<|endoftext|>b  \n", "  <|endoftext|> \t x", "é" * 300, "日本語　\x1c\x85b 🙂🙂'll 've", "x" * 70, "ab" * 3000]
    codec, cache = bpe.Codec(open(tokenizer_path(), encoding="utf-8").read()), {}
    for text, packed in zip(texts, codec.encode(texts, cache)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)
    got = bpe.tokenize(odd, tokenizer_path(), with_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[:2]] == [(0, empty, empty)] * 2
    for r, (_, text) in zip(got, ODD):
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest() and len(r.ids) == r.n_tokens


# ---- mixing

def test_targets_are_the_reshared_ones(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 2000, None: 40}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    weights = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2)))
    target, open_, left = {}, dict(weights), float(sum(sizes.values()))
    while open_:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if w * level > 3 * sizes[s]]
        for s in over or list(open_):
            target[s] = 3.0 * sizes[s] if over else open_[s] * level
        if not over:
            break
        for s in over:
            left -= target[s]
            del open_[s]
    assert {r.source: r.target for r in rows} == pytest.approx(target)


def test_flight_keeps_totals_and_leaves_two():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 500, 400), np.full(400, 0.37)
    moved = mixing.flight(p, size, rng.random(400))
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert moved.sum() == pytest.approx(p.sum()) and (moved * size).sum() == pytest.approx((p * size).sum())
    landed = mixing.landing(p, size, moved)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) < 2


def test_mix_takes_near_the_targets_and_reruns_agree(spark, odd):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    a, b = (QUERIES["op2_mixing"](spark, SF_ORACLE).toPandas().sort_values("doc_id") for _ in range(2))
    assert (a.taken.to_numpy() == b.taken.to_numpy()).all() and len(a) == docs.count()
    assert (a.taken <= 3 * a["size"]).all() and a.groupby("source").target.first().sum() == pytest.approx(a["size"].sum())
    by = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 0.01 * by.target + 2).all()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == int((a.taken / a["size"].where(a["size"] > 0, 1)).sum())
    rows = odd.withColumn("source", F.when(F.col("doc_id") > 3, "s"))
    planned = mixing.plan(rows).collect()
    assert len(planned) == len(ODD) and all(r.copies * r["size"] <= 3 * r["size"] for r in planned)
    assert mixing.mix(rows).columns == rows.columns and mixing.plan(rows.where("false")).count() == 0


def test_cube_in_several_rounds(spark):
    units = spark.range(3000).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("size"),
                                     F.lit(1).cast("bigint").alias("j"), F.lit(0.4).alias("p"), F.lit(3000).alias("n"))
    got = mixing.cube(units, block=100, fan=4).toPandas()
    assert len(got) == 3000 and abs(got.extra.sum() - 1200) <= 3
    assert abs((got.extra * got["size"]).sum() - 0.4 * got["size"].sum()) <= 100


def test_held_out_fold(spark):
    import zlib
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
