"""PII, language, toxicity and licences."""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import pii
from lodestone.llm.langid import PPMModel, identify_language, language_id
from lodestone.llm.licenses import RESERVED, TEMPLATES, TERM, Templates, document_paths, scan_licenses, statements, terms, units
from lodestone.llm.sampling import draw, labelled_sample
from lodestone.llm.toxicity import chains, fit_crf, label_tokens, marginals, pair_marginals, score_toxicity, tokens_of, toxicity

KEY = "k"


def plain_feistel(a, b, sizes, tweak):
    for i in range(pii.ROUNDS):
        f = lambda x, size: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16) % size  # noqa: B023, E731
        if i % 2 == 0:
            a = (a + f(b, sizes[0])) % sizes[0]
        else:
            b = (b + f(a, sizes[1])) % sizes[1]
    return a, b


def plain_digits(d, tweak):
    u = len(d) // 2
    a, b = plain_feistel(int(d[:u] or 0), int(d[u:]), (10**u, 10 ** (len(d) - u)), f"{tweak}{len(d)}")
    return (str(a).zfill(u) if u else "") + str(b).zfill(len(d) - u)


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0


def iban_ok(v):
    v = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def pseudo(spark, values):
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in enumerate(values)], "doc_id long, text string, found int, values string")
    return [r for r in pii.pseudonymize(df, key=KEY).orderBy("doc_id").collect()]


CASES = {
    "card": ["4111111111111111", "4111-1111-1111-1111", "5500 0000 0000 0004"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
    "date": ["1999-12-31", "1999/12/31", "2024/01/05", "24.12.1985", "7/4/2020", "12/31/1999", "2000-02-29", "1900-01-01", "2099-12-31"],
    "ip": ["10.0.0.1", "255.255.255.255"],
    "ssn": ["123-45-6789", "899-99-9999", "667-01-0001"],
    "phone": ["+1 (017) 555-7713", "0049 30 1234567", "0044-20-7946-0958", "(212) 555-0100", "212-555-0100"],
    "email": ["Jane.Doe+x9@mail.example.com", "the.72@mail3.example.com", "müller@example.de", "Öz.Ån3@example.se"],
}


def valid(kind, v):
    if kind == "card":
        return luhn(re.sub(r"\D", "", v))
    if kind == "iban":
        return iban_ok(v)
    if kind == "ip":
        return all(0 <= int(x) <= 255 for x in v.split("."))
    if kind == "ssn":
        a, g, s = map(int, v.split("-"))
        return 1 <= a <= 899 and a != 666 and g > 0 and s > 0
    return True


def test_formats_are_kept(spark):
    cases = [(kind, v) for kind in sorted(CASES) for v in CASES[kind]]
    for (kind, text), r in zip(cases, pseudo(spark, [f"see {v}, or {v}." for _, v in cases]), strict=True):
        assert r.kinds == [kind, kind], text
        first, second = re.fullmatch(r"see (.*), or (.*)\.", r.text).groups()
        assert first == second != text
        assert valid(kind, first)
        if kind != "ip":
            assert shape(first) == shape(text)
        if kind == "date" and first[4] in "-/":
            assert 1900 <= datetime.date.fromisoformat(first.replace("/", "-")).year <= 2099


def test_addresses_with_other_letters(spark):
    assert len(pii.ACCENTED) == len(pii._UPPER) == len(set(pii.ACCENTED + pii._UPPER)) / 2
    got = [r.text for r in pseudo(spark, [f"m{c}ller@example.de" for c in pii.ACCENTED] + ["ller@example.de", "иван@example.ru", "müller@example.de"])]
    assert len(set(got[: len(pii.ACCENTED)])) == len(pii.ACCENTED)
    assert not any("ller@" in t or t.startswith("m") and "ller" in t for t in got[:-2])
    assert got[-2] == "иван@example.ru" and got[-1] == got[pii.ACCENTED.index("ü")]
    a, b = pseudo(spark, ["0049 30 1234567", "call 0049 30 1234567 now"])
    assert a.kinds == b.kinds == ["phone"] and a.text.startswith("0049 ") and a.text in b.text
    a, b = pseudo(spark, ["1999-12-31", "1999/12/31"])
    assert a.text.replace("-", "/") == b.text  # one day, one pseudonym


def shape(v):
    v = "".join("A" if c in pii._UPPER else "a" if c in pii.ACCENTED else c for c in v)
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", v)))


def test_equal_values_stay_linked_and_match_brute_force(spark):
    a, b, c = pseudo(spark, ["4111111111111111", "x 4111-1111-1111-1111 y", "+49 30 1234567"])
    digits = re.sub(r"\D", "", b.text)
    assert a.text == digits
    assert digits[:-1] == plain_digits("411111111111111", "card")
    assert c.text.startswith("+49 ")
    assert re.sub(r"\D", "", c.text[4:]) == plain_digits("301234567", "phone")


def test_permutations_are_one_to_one(spark):
    got = spark.range(10_000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 4, "0"), KEY, "t").alias("d")).distinct().count()
    assert got == 10_000
    letters = spark.range(676).select(pii.permute_letters(F.concat(F.char(97 + F.floor(F.col("id") / 26)), F.char(97 + F.col("id") % 26)), KEY, "t").alias("d")).distinct().collect()
    assert len(letters) == 676
    assert all(re.fullmatch("[a-z]{2}", r.d) for r in letters)


def written_forms():
    """Every date of 1900 to 2099 in every form it can be written in."""
    forms = {}
    day = datetime.date(1900, 1, 1)
    while day.year < 2100:
        y, m, d = day.year, day.month, day.day
        forms.setdefault("iso", []).append(day.isoformat())
        for a in {str(d), f"{d:02}"}:
            for b in {str(m), f"{m:02}"}:
                forms.setdefault(f"dm{len(a)}{len(b)}", []).append(f"{a}.{b}.{y}")
                if d > 12:
                    forms.setdefault(f"md{len(b)}", []).append(f"{b}/{a}/{y}")
        day += datetime.timedelta(days=1)
    return forms


def test_dates_are_one_to_one_in_each_form(spark):
    forms = written_forms()
    df = spark.createDataFrame([(form, v) for form, values in forms.items() for v in values], "form string, v string").repartition(8)
    got: dict = {}
    for r in df.select("form", "v", pii._date(F.col("v"), KEY).alias("new")).collect():
        got.setdefault(r.form, []).append((r.v, r.new))
    for form, values in forms.items():
        assert {new for _, new in got[form]} == set(values), form
        assert sum(v == new for v, new in got[form]) < 40 + len(values) // 100, form


def test_short_addresses(spark):
    letters = [r.text for r in pseudo(spark, [f"{c}@x.com" for c in "abcdefghijklmnopqrstuvwxyz"])]
    assert len(set(letters)) == 26
    assert len({(ord(t[0]) - ord(c)) % 26 for t, c in zip(letters, "abcdefghijklmnopqrstuvwxyz", strict=True)}) > 5  # no constant shift
    digits = [r.text for r in pseudo(spark, [f"{c}@x.com" for c in range(10)])]
    assert len(set(digits)) == 10
    assert digits != [f"{c}@x.com" for c in range(10)]
    order = sorted("0123456789", key=lambda c: hashlib.sha256(f"{KEY}|email|one|{c}".encode()).hexdigest())
    assert [t[0] for t in digits] == order
    pairs = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    assert len({r.text for r in pseudo(spark, [f"{p}@x.com" for p in pairs])}) == 676


def test_other_formats_match_brute_force(spark):
    ip, ssn, iban, mail = (r.text for r in pseudo(spark, ["10.20.30.40", "123-45-6789", "DE89 3704 0044 0532 0130 00", "Ab12@x.org"]))
    a, b = plain_feistel(10 * 256 + 20, 30 * 256 + 40, (65536, 65536), "ip")
    assert ip == f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    a, b = plain_feistel(122, 44 * 9999 + 6788, (pii.AREAS, pii.SERIALS), "ssn")
    assert ssn == f"{a + 1 + (a >= 665):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    bank = plain_digits("370400440532013000", "iban")
    rest = int("".join(str(int(c, 36)) for c in bank + "DE00")) % 97
    assert iban.replace(" ", "") == f"DE{98 - rest:02}{bank}"
    x, y = plain_feistel(0, 1, (26, 26), "email2")
    assert mail == f"{chr(65 + x)}{chr(97 + y)}{plain_digits('12', 'email')}@x.org"
    again = pseudo(spark, ["10.20.30.40"] * 3)
    assert {r.text for r in again} == {ip}
    nameless = spark.createDataFrame([(None, "10.20.30.40")] * 2, "doc_id long, text string")
    assert [tuple(r)[:3] for r in pii.pseudonymize(nameless, key=KEY).collect()] == [(None, ip, 1)] * 2


def test_what_is_not_personal_stays(spark):
    texts = ["4111111111111112", "999.1.1.1", "000-12-3456", "31.02.2020", "DE89370400440532013001", "version 1.2.3", "12345", "", None, "no digits at all", "a" * 50_000 + " 5"]
    for text, r in zip(texts, pseudo(spark, texts), strict=True):
        assert (r.text, r.n_values, r.kinds) == (text, 0, [])
    assert pii.pseudonymize(spark.createDataFrame([], "doc_id long, text string"), key=KEY).count() == 0


def test_neighbours_stay_apart(spark):
    phone, ip, card, iban = "+1 (826) 555-4081", "190.137.223.204", "4467920212765298", "ES91 2100 0418 4502 0005 1332"
    texts = [phone, ip, card, iban, "2020-01-02", f"{phone} {ip}", f"No 5 {card}", f"{card} 12", f"{iban} IN", "2020-01-02T10:00:00Z", f"{phone} {card}", f"{phone} 123-45-6789", f"{phone} 12", "123-45-6789"]
    got = pseudo(spark, texts)
    p, i, c, b, d, ssn = (got[k].text for k in (0, 1, 2, 3, 4, 13))
    assert [r.text for r in got[5:13]] == [f"{p} {i}", f"No 5 {c}", f"{c} 12", f"{b} IN", f"{d}T10:00:00Z", f"{p} {c}", f"{p} {ssn}", f"{p} 12"]
    assert [r.kinds for r in got[5:13]] == [["phone", "ip"], ["card"], ["card"], ["iban"], ["date"], ["phone", "card"], ["phone", "ssn"], ["phone"]]


def test_long_addresses_are_permuted_whole(spark):
    letters, digits = "a" * 26 + "lastname", "1" * 36 + "2345678"
    a, b = pseudo(spark, [f"{letters}@example.com", f"x{digits}@example.com"])
    assert a.text[26:34] != "lastname"
    assert b.text[37:44] != "2345678"
    assert shape(a.text) == "a" * 34 + "@aaaaaaa.aaa"
    assert shape(b.text) == "a" + "0" * 43 + "@aaaaaaa.aaa"


def plain_ppm(train, order, least, context, symbol):
    """Cost in bits of a byte after a context, straight from the definition."""
    def follow(c):
        out = {}
        for t in train:
            for i in range(len(c), len(t)):
                if t[i - len(c) : i] == c:
                    out[t[i]] = out.get(t[i], 0) + 1
        return out

    p, seen = 1.0, set()
    for k in range(min(order, len(context)), -1, -1):
        counts = follow(context[len(context) - k :])
        if k and sum(counts.values()) < least:
            continue
        counts = {s: n for s, n in counts.items() if s not in seen}
        if not counts:
            continue
        total = sum(counts.values()) + len(counts)
        if symbol in counts:
            return -np.log2(p * counts[symbol] / total)
        p *= len(counts) / total
        seen |= set(counts)
    return -np.log2(p / (256 - len(seen)))


def test_ppm_matches_definition():
    train = [b"abracadabra", b"banana band", b"a"]
    model = PPMModel.fit({"x": train, "y": [b"zzz yyy zz"]}, order=2)
    texts = [b"abra", b"", b"band q", b"\xff\xfea"]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])[:-1]
    got = model.code_lengths(data, starts)
    for t, bits in zip(texts, got, strict=True):
        known = [bytes(c if model.symbol[c] else 0 for c in t)]  # bytes never seen are no context
        want = sum(plain_ppm(train, 2, 2, known[0][:i], t[i]) for i in range(len(t)))
        assert bits[0] == pytest.approx(want, rel=1e-5)
    alone = np.concatenate([model.code_lengths(np.frombuffer(t, np.uint8), np.zeros(1, np.int64)) for t in texts])
    assert np.allclose(alone, got)


def test_long_texts_are_scored_in_stretches():
    import tracemalloc

    model = PPMModel.fit({"x": [b"abracadabra banana band"], "y": [b"zzz yyy zz"]}, order=3)
    text = np.random.default_rng(1).choice(np.frombuffer(b"abrcdnz y", np.uint8), 3_000_000)
    begin = np.zeros(1, np.int64)
    tracemalloc.start()
    got = model.code_lengths(text, begin)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
    assert np.allclose(got, model.code_lengths(text, begin, chunk=len(text)), rtol=1e-12, atol=0)
    assert np.allclose(model.code_lengths(text[:50], begin, chunk=2), model.code_lengths(text[:50], begin), rtol=1e-12, atol=0)  # stretches shorter than a context


def test_workers_take_texts_by_bytes():
    import pyarrow as pa

    from lodestone.llm.langid import MOST_BYTES, MOST_ROWS, _parts

    texts = ["x" * 700_000, "y" * 700_000, None, "z" * 3_000_000, "", *["w"] * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(_parts(batch, 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= MOST_ROWS and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= MOST_BYTES) for p in parts)
    assert list(_parts(batch.slice(0, 0), 1)) == []


def test_what_a_stage_keeps_goes_with_the_next():
    from lodestone.llm.common import kept, releasing

    made = []
    task = lambda name: list(releasing(lambda batches: iter([kept(name, lambda: made.append(name) or name)]), keeps=name)(iter([])))
    assert task("a") == task("a") == ["a"] and made == ["a"]
    assert list(releasing(lambda batches: batches)(iter([1]))) == [1]
    task("a")
    assert made == ["a", "a"]


def test_language_edges(spark):
    rows = [(i, ("the cat and the hat " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de", "z") for i in range(60)]
    rows += [(100, None, "en", "z"), (101, "", None, "z"), (102, "12 34 !", "en", "z"), (103, "the hat", None, "z"), (None, "der hund", "de", "z"), (103, "the hat", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert (got[100].lang_pred, got[101].lang_pred, got[102].lang_pred) == ("und", "und", "und")
    assert (got[103].lang_pred, got[None].lang_pred) == ("en", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id(df.where("false")).count() == 0
    assert identify_language(df, None).select("lang_pred").distinct().first()[0] == "und"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    move = np.array([[0.7, 0.3], [0.4, 0.6]])
    lengths = [1, 5, 3]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    odds = rng.uniform(0.1, 5, ends[-1])
    got = marginals(odds, starts, ends, move)
    for lo, hi in zip(starts, ends, strict=True):
        n = hi - lo
        total, hits = 0.0, np.zeros(n)
        for tags in np.ndindex(*[2] * n):
            w = np.prod([odds[lo + t] if y else 1 for t, y in enumerate(tags)]) * np.prod([move[a, b] for a, b in zip(tags, tags[1:], strict=False)])
            total += w
            hits += w * np.array(tags)
        assert np.allclose(got[lo:hi], hits / total)


def test_pair_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    move = np.array([[1.0, 0.3], [1.0, 2.5]])
    odds, starts, ends = rng.uniform(0.1, 5, 9), np.array([0, 4]), np.array([4, 9])
    inner = np.array([1, 2, 3, 5, 6, 7, 8])
    want = np.zeros((2, 2))
    for lo, hi in zip(starts, ends, strict=True):
        total, pairs = 0.0, np.zeros((2, 2))
        for tags in np.ndindex(*[2] * (hi - lo)):
            w = np.prod([odds[lo + t] if y else 1 for t, y in enumerate(tags)]) * np.prod([move[a, b] for a, b in zip(tags, tags[1:], strict=False)])
            total += w
            for a, b in zip(tags, tags[1:], strict=False):
                pairs[a, b] += w
        want += pairs / total
    assert np.allclose(pair_marginals(odds, *chains(odds, starts, ends, move), inner, move), want)


def test_offsets_are_those_of_the_text(spark):
    crf = fit_crf(corpus())
    texts = ["\u0130\u0130\u0130 baren Nasty baren", "x" * 60_000 + " nasty", "NASTY nasty\n\u0130"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    rows = score_toxicity(df, crf).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.spans
        for s in r.spans:
            assert {w.lower() for w in texts[r.doc_id][s.start : s.end].split()} == {"nasty"}
    assert tokens_of("ba\u0130 Ren")[1] == "ren"


def test_scores_match_a_plain_forward_backward(spark):
    crf = fit_crf(corpus())
    rows = [(i, t) for i, (_, t) in enumerate(corpus(40, 3))]
    got = {r.doc_id: r.score for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), crf).collect()}
    number = lambda w: crf.vocabulary.get(w) or next((crf.vocabulary[w[:k] + "*"] for k in (7, 6, 5, 4) if len(w) > k and w[:k] + "*" in crf.vocabulary), 0)
    for i, text in rows:
        e = [crf.odds[number(w)] for w in text.lower().split()]
        forward = [np.array([1.0, e[0]])]
        for x in e[1:]:
            f = (forward[-1] @ crf.move) * [1.0, x]
            forward.append(f / f.sum())
        backward = [np.ones(2)]
        for x in e[:0:-1]:
            b = crf.move @ ([1.0, x] * backward[-1])
            backward.append(b / b.sum())
        p = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, backward[::-1], strict=True)]
        want = 1 / (1 + np.exp(-np.dot([1.0, max(p), np.log1p(sum(p))], crf.document)))
        assert got[i] == pytest.approx(want, abs=1e-9)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_labels_change_nothing(spark):
    texts = [t for _, t in corpus(200, 1)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    runs = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, int((i % 4 == 0) != (flip and held(i)))) for i in range(200)], "doc_id long, toxic int")
        other = df.withColumn("lang", F.when(F.lit(flip) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2), "xx").otherwise(F.col("lang")))
        tox = sorted((r.doc_id, r.score, r.held_out) for r in toxicity(df, labels).collect())
        lang = sorted((r.doc_id, r.lang_pred, r.score, r.held_out) for r in language_id(other).collect())
        assert [h for _, _, h in tox] == [h for *_, h in lang] == [held(i) for i in range(200)]
        runs.append((tox, lang))
    assert runs[0] == runs[1]


def test_sample_of_repeated_rows(spark):
    rows = [(1, "same text", "a")] * 3000 + [(1, f"text {i}", "b") for i in range(3000)] + [(4, "one", "c"), (1, None, "c"), (1, "", "c"), (None, "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string").withColumns({"size": F.octet_length("text"), "draw": draw("doc_id", "text")})
    assert not held(1) and not held(4)
    got = labelled_sample(df, 100, 1000)
    by = {k: [r for r in got if r["label"] == k] for k in "abc"}
    assert [len(by[k]) for k in "abc"] == [1, 100, 1]
    assert len({r["text"] for r in by["b"]}) == 100
    assert got == labelled_sample(df.repartition(5), 100, 1000)


def test_language_table_is_bounded():
    texts = {"a": [b"the cat and the hat " * 5], "b": ["\u4e2d\u6587\u5b57\u7b26".encode() * 9, bytes(range(65, 123)) * 3]}
    whole, small = PPMModel.fit(texts), PPMModel.fit(texts, most_bytes=20_000)
    assert small.bits.nbytes <= 20_000 < whole.bits.nbytes
    data = np.frombuffer(b"the cat", np.uint8)
    for model in (whole, small):
        assert model.code_lengths(data, np.zeros(1, np.int64))[0].argmin() == 0


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ba", "de", "li", "mo", "su", "ta") for b in ("ren", "lin", "tas", "vor", "mek")]
    out = []
    for i in range(n):
        tokens = list(rng.choice(words, 40))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            tokens.insert(int(rng.integers(40)), str(rng.choice(["vilea", "vileb", "vilec", "nasty"])))
        out.append((int(toxic), " ".join(tokens)))
    return out


def test_toxicity(spark):
    assert "nasty" in label_tokens([(y, t.split()) for y, t in corpus()])
    crf = fit_crf(corpus())
    rows = [(i, t) for i, (_, t) in enumerate(corpus(200, 1))] + [(500, None), (501, ""), (None, "baren Nasty baren"), (502, "123 ##")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in score_toxicity(df, crf).collect()}
    assert len(got) == len(rows)
    right = sum(got[i].predicted == y for i, (y, _) in enumerate(corpus(200, 1)))
    assert right >= 195
    assert [(s.start, s.end) for s in got[None].spans] == [(6, 11)]
    assert got[500].predicted == got[501].predicted == got[502].predicted == 0
    assert score_toxicity(df.where("false"), crf).count() == 0
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(corpus(200, 1))] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity(df, labels).count() == len(rows)
    assert toxicity(df.where("false"), labels.where("false")).count() == 0


def test_licenses(spark):
    rows = [
        ("p/LICENSE", "Released under the MIT License."), ("p/a.py", "code\ncode"), ("p/sub/b.py", "x" * 200), ("p/sub/deep/c.py", None),
        ("p/sub/COPYING", "Licensed under the Apache License, Version 2.0."), ("p/d.py", "word " * 100 + "\nLicensed under CC BY-NC 4.0."), ("q/e.py", ""), (None, "text"), ("q/e.py", ""),
    ]
    got = [r for r in scan_licenses(spark.createDataFrame([(*r, 1, 2) for r in rows], "path string, text string, own int, cosine int")).collect()]
    by = {r.path: (r.license, r.origin) for r in got}
    assert len(got) == len(rows)
    assert by["p/LICENSE"] == ("MIT", "file")
    assert by["p/a.py"] == ("MIT", "inherited")
    assert by["p/sub/b.py"] == ("Apache-2.0", "inherited")
    assert by["p/sub/deep/c.py"] == ("Apache-2.0", "inherited")
    assert by["p/d.py"] == ("CC-BY-NC-4.0", "header")
    assert by["q/e.py"] == by[None] == (None, "none")
    assert scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def test_licenses_in_prose_and_bodies(spark):
    body = "Copyright (c) 2020, Jo Doe\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software."
    prose = "The quick brown fox jumps over lazy dogs near rivers. Released under the MIT License. Another ordinary sentence follows with many words about rivers and hills. " + "More words go here today. " * 30
    rows = [("a/x.txt", prose), ("b/LICENSE", body), ("c/y.txt", "word " * 300 + ". Licensed under the Apache License, Version 2.0. Then it goes on.")]
    by = {r.path: r.license for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert by == {"a/x.txt": "MIT", "b/LICENSE": "BSD-3-Clause", "c/y.txt": "Apache-2.0"}


def test_statements_are_not_overridden(spark):
    named = {"GPL-2.0": "licensed under the GNU General Public License, version 2.", "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3.", "BSD-2-Clause": "Licensed under the BSD 2-Clause License.", "CC0-1.0": "Released under CC0 1.0.", "LicenseRef-All-Rights-Reserved": "Copyright (c) 2020 Jo Doe. All rights reserved."}
    rows = [("p/LICENSE", "Released under the MIT License."), ("p/odd.txt", "x " * 300 + "\nThe licence of the Zorgon bureau covers all these strange things")]
    rows += [(f"p/n{k}.txt", "x " * 300 + "\n" + t) for k, t in named.items()]
    by = {r.path: (r.license, r.origin) for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert by["p/odd.txt"] == (None, "unknown")
    assert {k: by[f"p/n{k}.txt"] for k in named} == {k: (k, "header") for k in named}


def test_cosines_match_a_plain_count():
    model = Templates()
    rows = [(name, terms(t)) for name in sorted(TEMPLATES) for t in TEMPLATES[name]]
    df = {}
    for _, found in rows:
        for w in set(found):
            df[w] = df.get(w, 0) + 1
    idf = lambda w: np.log((1 + len(rows)) / (1 + df.get(w, 0))) + 1

    def vector(found):
        return {w: found.count(w) * idf(w) for w in set(found)}

    def cosine(a, b):
        dot = sum(x * b.get(w, 0.0) for w, x in a.items())
        return dot / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    rng = np.random.default_rng(3)
    pool = [w for ts in TEMPLATES.values() for t in ts for w in t.split()] + ["river", "Hund", "x1", "stone"] * 20
    for _ in range(60):
        text = " ".join(rng.choice(pool, int(rng.integers(1, 30))))
        found = terms(text)
        if not found:
            continue
        want = max((cosine(vector(found), vector(other)), name) for name, other in rows)
        name, got = model.closest(text)
        assert got == pytest.approx(want[0])
        assert got == 0 or any(n == name and cosine(vector(found), vector(o)) == pytest.approx(got) for n, o in rows)
    assert model.closest("") == (None, 0.0)


def test_every_template_is_found(spark):
    rows, want = [], {}
    for name, texts in TEMPLATES.items():
        for k, t in enumerate(texts):
            rows.append((f"{name}-{k}/LICENSE", t))
            want[f"{name}-{k}/LICENSE"] = t
    got = {r.path: (r.license, r.origin) for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    names = {}
    for name, texts in TEMPLATES.items():
        for t in texts:
            names.setdefault(t, set()).add(name)
    for path, t in want.items():
        assert got[path][1] == "file", path
        assert got[path][0] in names[t] or got[path][0] == RESERVED, (path, got[path])
    long = "Some notice\n\n   GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + "Everyone is permitted to copy and distribute verbatim copies. " * 400
    assert max(cosine for _, _, name, cosine in statements(long, Templates(), whole=True) if name == "GPL-3.0") >= 0.5


FSF = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {family} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
STATED = {
    "LGPL-2.1": FSF.format(what="library", family="Lesser General Public License", version="2.1"),
    "GPL-2.0": FSF.format(what="program", family="General Public License", version="2"),
    "AGPL-3.0": FSF.format(what="program", family="Affero General Public License", version="3"),
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License)",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-1.1": "The Apache Software License, Version 1.1",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License)",
    "EPL-1.0": "made available under the terms of the Eclipse Public License v1.0",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-3.0": "licensed under a Creative Commons Attribution-ShareAlike 3.0 International License",
    "GPL-2.0-or-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "GPL-2.0 ": "// SPDX-License-Identifier: GPL-2.0-only",
    "EUPL-1.2": "SPDX-License-Identifier: EUPL-1.2",
    "MIT OR Apache-2.0": "# SPDX-License-Identifier: MIT OR Apache-2.0",
    "MIT": "Released under the MIT License.",
}


def test_versions_and_families(spark):
    around = "Some ordinary words stand here before it.\n{}\nAnd here are other ordinary words that go on for a while about rivers."
    rows = [(f"{k}/x.txt", around.format(t)) for k, t in STATED.items()]
    got = {r.path: (r.license, r.origin) for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: got[f"{k}/x.txt"][0] for k in STATED} == {k: k.strip() for k in STATED}


def test_denied_and_general_mentions(spark):
    rows = [("p/LICENSE", "Released under the MIT License.")]
    rows += [(f"p/{k}.txt", t) for k, t in {
        "denied": "This text is not released under the MIT License.", "driving": "You need a driving licence to hire a car.", "fee": "The licence fee rose again.",
        "stated": "Licensed under the Zorgon bureau rules.", "notice": "Copyright 2019 by nobody known. Use as you like", "plain": "words",
        "disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    }.items()]
    got = {r.path: (r.license, r.origin) for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert all(got[f"p/{k}.txt"] == ("MIT", "inherited") for k in ("denied", "driving", "fee", "plain"))
    assert all(got[f"p/{k}.txt"] == (None, "unknown") for k in ("stated", "notice"))
    assert got["p/disclaimer.txt"][0].startswith("BSD")


def test_statements_anywhere_in_a_very_long_text(spark):
    prose = "The river runs past the old mill and on to the sea where boats wait. " * 8000
    rows = [("a/x.txt", prose + "Released under the MIT License. " + prose), ("b/x.txt", prose + "\n" + "y " * 5000 + "Licensed under the Apache License, Version 2.0. " + "z " * 5000)]
    got = {r.path: (r.license, r.origin) for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/x.txt"] == ("MIT", "header")
    assert got["b/x.txt"][1] in ("header", "unknown", "none")


def test_bounds_hold():
    model, rng = Templates(), np.random.default_rng(7)
    pool = [w for ts in TEMPLATES.values() for t in ts for w in t.split()] + ["river", "stone", "Hund"] * 40
    for _ in range(300):
        text = " ".join(rng.choice(pool, int(rng.integers(1, 25))))
        assert model.bound(TERM.findall(text.lower())) >= model.closest(text)[1] - 1e-9
    assert [("a\n\nb c. D e")[lo:hi] for lo, hi in units("a\n\nb c. D e")] == ["a", "b c.", "D e"]
    assert units("") == []


def test_scan_end_to_end(spark):
    """Statements, files and inheritance of a whole table against one text and one folder at a time."""
    model, docs = Templates(), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in document_paths(docs).collect()]
    rows += [("src1/LICENSE", "Released under the MIT License."), ("src2/0/COPYING", STATED["LGPL-2.1"]), (None, "x"), ("src1/none", None)]
    found = {}
    for p, t in rows:
        good = [(c, n) for _, _, n, c in statements(t or "", model, whole=bool(p and p.rsplit("/", 1)[-1] in ("LICENSE", "COPYING"))) if n and c >= 0.5]
        good = [x for x in good if x[1] != RESERVED] or good
        found[p] = max(good, key=lambda x: x[0])[1] if good else None
    got = {r.path: r for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    files = {p.rsplit("/", 1)[0]: p for p in got if p and got[p].origin == "file"}
    for p, t in rows:
        if found[p] is not None:
            assert got[p].license == found[p] and got[p].origin in ("file", "header")
        elif got[p].origin == "inherited":
            parts = p.split("/")[:-1]
            above = next(f for f in ("/".join(parts[:k]) for k in range(len(parts), -1, -1)) if f in files)
            assert got[p].license == got[files[above]].license
        else:
            assert got[p].license is None
    assert got["src1/none"].license == "MIT" and got[None].license is None
