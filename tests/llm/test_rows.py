"""URL rules, mixing, language ID, packing, pseudonyms."""

import math
import random
import re
import zlib

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slicewise.llm import language_id, mixing, packing, pii, url_filter


def rows(df):
    return [tuple(r) for r in df.collect()]


# URL filter

def test_trie_equals_a_scan_of_all_rules():
    rng = random.Random(3)
    hosts = ["org", "example.org", "a.example.org", "com", "x.com", "ample.org"]
    paths = ["/", "/e", "/en", "/en/", "/en/1", "/es/", "/en/12/x", ""]
    for _ in range(300):
        rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(rng.randrange(1, 9))]
        host = rng.choice(["", "www.", "a."]) + rng.choice([*hosts, "example.net", "", "notorg"])
        path = rng.choice([*paths, "/en/123", "/en/12/xy", "/es/ab?"])
        fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = (max(fits)[3], max(fits)[4]) if fits else None
        assert url_filter.match(url_filter.build_trie(rules), host, path) == want, (rules, host, path)


def test_url_filter_cases(spark):
    urls = ["HTTP://Blog.Example.ORG/en/12?x#y", "no scheme", None, "https://x.com", "http://x.com/de/1", "http://a.com/fr/#f", "http://example.org/es/", "",
            "a://b://c.org/d", "http://exÄmple.org/en/1", "http://com/de/?"]
    df = spark.createDataFrame([(i, u, None, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(df.union(df.limit(1)), url_filter.RULES).collect()}
    assert got[0] == ("blog.example.org", "/en/12", "example.org/en/1", "block")
    assert got[1] == got[2] == got[7] == ("", "", None, "allow")
    assert got[3] == ("x.com", "", None, "allow") and got[4][2:] == ("com/de/", "block") and got[5][1:] == ("/fr/", "com/fr/", "allow")
    assert got[6][2] == "example.org/es/" and got[8][:2] == ("b:", "//c.org/d") and got[9][0] == "exÄmple.org" and got[10][3] == "block"
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.build_trie([("block", "h" * (url_filter.MAX_RULE_BYTES + 1), "/")])


# mixing

def reference_targets(sizes):
    total, weight = sum(sizes.values()), {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(sizes), float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    data = [(i, " ".join("w" * 1 for _ in range(rng.randrange(0, 400))), rng.choice(["a"] * 30 + ["b", "c", "é", None, "Z"])) for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    sizes = {s: sum(len(t.split()) for _, t, x in data if x == s) for s in {x for *_, x in data}}
    want = reference_targets(sizes)
    for s, part in got.groupby(got["source"].where(got["source"].notna(), "none")):
        key = None if s == "none" else s
        assert part["source_size"].iloc[0] == sizes[key]
        assert math.isclose(part["target"].iloc[0], want[key], rel_tol=1e-9)
        assert abs(part["taken"].sum() - want[key]) <= 6 * mixing.BLOCK_WORDS
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_mix_cases(spark):
    docs = brute.odd(spark)
    got = mixing.mix(docs)
    assert got.count() == docs.count() and got.filter("taken > 3 * size OR (size = 0 AND taken <> 0)").count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.schema == docs.schema
    words = lambda df: df.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words(mixed) == got.agg(F.sum("taken")).first()[0]
    assert mixed.filter("n_chars <> length(text)").count() == 0
    none = brute.odd(spark, []).repartition(1)
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0
    blank = none.union(docs.filter("text IS NULL"))
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0]


# language ID

def plain_code_length(model_words, lang, word, max_order):
    """Bits of one word by dictionaries instead of sorted arrays."""
    seen = [dict() for _ in range(max_order + 1)]
    for la, w, n in model_words:
        b = b" " + w.encode() + b" "
        if la == lang:
            for i in range(1, len(b)):
                for k in range(min(max_order, i) + 1):
                    c = seen[k].setdefault(b[i - k:i], {})
                    c[b[i]] = c.get(b[i], 0) + n
    b, bits = b" " + word.encode() + b" ", 0.0
    for i in range(1, len(b)):
        for k in range(min(max_order, i), -1, -1):
            c = seen[k].get(b[i - k:i])
            if c:
                t, d = sum(c.values()), len(c)
                if b[i] in c:
                    bits -= math.log2(c[b[i]] / (t + d))
                    break
                bits -= math.log2(d / (t + d))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_plain_ppm():
    known = [("de", "der", 5), ("de", "die", 4), ("de", "straße", 1), ("en", "the", 9), ("en", "then", 2), ("en", "a", 3)]
    model = language_id.Model(pd.DataFrame(known, columns=["lang", "word", "n"]))
    words = ["the", "der", "straßen", "x", "zzthe", "日本"]
    got = model.code_lengths([w.encode() for w in words])
    want = [[plain_code_length(known, la, w, language_id.MAX_ORDER) for la in ("de", "en")] for w in words]
    assert np.allclose(got, want, atol=1e-3)
    scorer = language_id.Scorer(model)
    assert scorer.predict(["the der the", None, "12 !?", ""])[1:] == [("und", 0.0)] * 3
    many = scorer.predict(["the the then", "der die"])
    assert [m[0] for m in many] == ["en", "de"] and all(0 <= m[1] <= 1 for m in many)


def test_word_table_may_overflow(monkeypatch):
    monkeypatch.setattr(language_id, "CACHE_WORDS", 5)
    model = language_id.Model(pd.DataFrame([("de", "der", 1), ("en", "the", 1)], columns=["lang", "word", "n"]))
    scorer = language_id.Scorer(model)
    texts = [" ".join(f"w{i}{k} the" for k in range(4)) for i in range(6)]
    one_by_one = [language_id.Scorer(model).predict([t])[0] for t in texts]
    assert [scorer.predict([t])[0] for t in texts] == one_by_one == scorer.predict(texts)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    part = got[got.held_out]
    assert (part.lang == part.lang_pred).mean() > 0.98


def test_language_cases(spark):
    docs = brute.odd(spark)
    model = language_id.learn(docs)
    got = language_id.with_language(docs, model)
    assert got.count() == docs.count() and set(got.columns) == set(docs.columns)
    by = {r["text"]: r for r in got.collect()}
    assert by[None]["lang_pred"] == by["12 345 !!"]["lang_pred"] == by[""]["lang_pred"] == "und" and by["einwort"]["lang_pred"] in ("de", "en")
    nothing = language_id.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.with_language(docs, nothing).collect()} == {"und"}
    assert language_id.with_language(docs.limit(0), model).count() == 0


# packing

def test_pack_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(packing.vocabulary_path())
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()]
    texts += [t for _, t, *_ in brute.odd_rows()] + ["it's We'RE 'state !'s", "a<|endoftext|>b", "naïve ÀÉ Ÿ ×÷ ª²", "e\u0301 \x85 \x1c", "'", "''s''t", "½ 9 99"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = packing.pack(df).toPandas()
    assert got["sequence_id"].is_unique and (got["offset"] == 0).all()
    for i, part in got.groupby("doc_id"):
        want = plain.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        part = part.sort_values("start")
        assert [x for ids in part["ids"] for x in ids] == want and part["length"].tolist() == packing.cuts(len(want))
        assert all(n & (n - 1) == 0 for n in part["length"]) and (part["doc_tokens"] == len(want)).all()
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in part["ids"]] == part["ids_crc32"].tolist()
    assert len(set(got["doc_id"])) == len(texts)


def test_pack_cases(spark, tmp_path):
    docs = brute.odd(spark)
    got = packing.pack(docs, with_ids=False)
    assert got.agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == docs.count()
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.cuts(2048 * 2 + 11) == [2048, 2048, 8, 2, 1]
    packing.write_buckets(packing.pack(docs.filter("doc_id < 4")), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).filter("bucket <> length").count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, max_len=1000)


# pseudonyms

VALUES = ["4532015112830366", "4532 0151 1283 0366", "378282246310005", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "2021-02-28", "28.02.2021",
          "078-05-1120", "+1 (743) 555-3824", "+49 30 1234567", "(743) 555-3824", "743-555-3824", "193.195.198.107", "jane.doe42@mail.example.com", "March 5, 1999", "17 July 2003"]


def test_permutation_is_a_bijection():
    f = pii.Feistel(b"k")
    for size in (1, 2, 3, 10, 100, 777):
        got = [f.permute(x, size, "t") for x in range(size)]
        assert sorted(got) == list(range(size)) and [f.permute(x, size, "t", True) for x in got] == list(range(size))
    assert [f.permute(x, 777, "t") for x in range(9)] != [pii.Feistel(b"l").permute(x, 777, "t") for x in range(9)]


@pytest.mark.parametrize("value", VALUES)
def test_values_keep_their_format_and_come_back(value):
    text = f"before {value}, after\n{value}\n({value})"
    new, spans = pii.Pseudonyms(b"k").apply(text)
    assert len(spans) == 3 and value not in new and all(text[b:b + n] == value for _, b, n in spans)
    repl = new.split("\n")[1]
    assert new == text.replace(value, repl) and len({k for k, _, _ in spans}) == 1
    again, found = pii.Pseudonyms(b"k").apply(repl)
    assert found == [(spans[0][0], 0, len(repl))]              # the pseudonym is valid in the same format
    assert pii.Pseudonyms(b"k", back=True).apply(new)[0] == text
    assert re.sub(r"\w", "", value) == re.sub(r"\w", "", repl)


def test_invalid_values_stay():
    text = "4532015112830367 143-555-3824 999.1.1.1 2021-02-30 000-12-1234 DE00 3704 0044 0532 0130 00 9.0. 12345 1.2.3.4.5 a1b2c3d4e5f67890123456 @x y@ 13/13/2020"
    assert pii.Pseudonyms(b"k").apply(text) == (text, [])


def test_equal_values_stay_linked():
    p = pii.Pseudonyms(b"k")
    strip = lambda s: re.sub(r"\D", "", s)
    assert strip(p.apply("4532015112830366")[0]) == strip(p.apply("x 4532-0151-1283-0366 y")[0])
    day = [p.apply(s)[0] for s in ("2021-02-28", "28.02.2021", "28/02/2021")]
    assert len({tuple(sorted(re.findall(r"\d+", d))) for d in day}) == 1


@pytest.mark.parametrize("spellings", [
    ["+1 415 555 2671", "+14155552671", "+1 (415) 555-2671", "+1-415-555-2671", "+1415 555 2671"], ["+49 30 1234567", "+49301234567", "+493 01234567"],
    ["+7 495 123 45 67", "+74951234567"], ["+358 40 1234567", "+358401234567", "+35 840 1234567"], ["+44 20 7946 0958", "+442079460958"],
    ["+44 (0)20 7946 0958", "+44(0)2079460958"], ["+39 06 1234 5678", "+390612345678"]])
def test_equal_phones_stay_linked(spellings):
    p = pii.Pseudonyms(b"k")
    new = [p.apply(f"x {s} y")[0][2:-2] for s in spellings]
    assert len({re.sub(r"\D", "", n) for n in new}) == 1 and not set(new) & set(spellings)
    assert [re.sub(r"\d", "0", n) for n in new] == [re.sub(r"\d", "0", s) for s in spellings]
    assert [pii.Pseudonyms(b"k", back=True).apply(n)[0] for n in new] == spellings


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def test_dates_of_every_form_are_restored():
    """Day first, month first (where the day shows it), padded or not, by name: the key gives every date back, and equal dates stay linked."""
    rng, there, back, seen = random.Random(12), pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True), {}
    for _ in range(1500):
        y, m, d = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 29)
        forms = {f"{y}-{m:02d}-{d:02d}": "ymd", f"{y}/{m:02d}/{d:02d}": "ymd", f"{d}.{m}.{y}": "dmy", f"{d:02d}.{m:02d}.{y}": "dmy", f"{d}/{m:02d}/{y}": "dmy",
                 f"{d:02d}-{m}-{y}": "dmy", f"{MONTHS[m - 1]} {d}, {y}": "mdy", f"{MONTHS[m - 1]} {d:02d}, {y}": "mdy", f"{d} {MONTHS[m - 1]} {y}": "dmy"}
        if d > 12:
            forms |= {f"{m}/{d}/{y}": "mdy", f"{m:02d}/{d:02d}/{y}": "mdy", f"{m:02d}-{d}-{y}": "mdy"}
        news = set()
        for text, order in forms.items():
            new, spans = there.apply(text)
            assert spans == [("date", 0, len(text))] and len(re.sub(r"[A-Za-z]", "", new)) == len(re.sub(r"[A-Za-z]", "", text))
            assert back.apply(new)[0] == text
            parts = [MONTHS.index(x) + 1 if x in MONTHS else int(x) for x in re.split(r"[-/. ,]+", new)]
            news.add(tuple(parts[order.index(c)] for c in "ymd"))
        assert len(news) == 1                                  # one date, whatever its form
        seen[(y, m, d)] = news.pop()
    assert len(set(seen.values())) == len(seen)


def test_common_forms_are_found():
    p, digits = pii.Pseudonyms(b"k"), lambda s: re.sub(r"\D", "", s)
    day = p.apply("2024-01-02")[0]
    for tail in ("T10:00:00", "T10:00:00.123+02:00", "t1000Z", "T10"):
        new, spans = p.apply(f"at 2024-01-02{tail}, then")
        assert new == f"at {day}{tail}, then" and spans == [("date", 3, 10)]
        assert pii.Pseudonyms(b"k", back=True).apply(new)[0] == f"at 2024-01-02{tail}, then"
    assert p.apply("2024-01-02Tuesday 2024-02-30T10:00")[1] == []
    trunk, plain = p.apply("+44 (0)20 7946 0958")[0], p.apply("+44 20 7946 0958")[0]
    assert trunk.startswith("+44 (0)") and trunk.replace("(0)", "") == plain    # the zero in brackets is not part of the number
    assert digits(p.apply("+39 06 1234 5678")[0])[:3] == "390"


def test_pseudonym_cases(spark):
    docs = brute.odd(spark)
    got = pii.pseudonymise(docs, b"k")
    assert got.count() == docs.count() and got.filter("text IS NULL").count() == 2 and got.filter("text = ''").count() == 1
    assert pii.pseudonymise(docs.limit(0), b"k").count() == 0
