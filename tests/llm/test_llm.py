"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm import components as C
from quernstone.llm import exact_dedup as X
from quernstone.llm import minhash_dedup as M
from quernstone.llm import queries as Q
from quernstone.llm import suffix_dedup as D
from quernstone.llm import token_output as H
from quernstone.llm.components import components
from quernstone.llm.decontaminate import clean_documents, contaminated
from quernstone.llm.license_scan import license_scan
from quernstone.llm.quality import Ordinal, fit_ordinal, fit_quality, score_quality
from quernstone.llm.source_mix import mix_sources, water_fill
from quernstone.llm.toxicity import fit_toxicity, fit_trees, isotonic, toxicity
from quernstone.llm.url_filter import url_filter

SF = "/root/testdata/sf0.001"
#: Columns that operators use inside, as further columns of the input.
CLASH = ("id", "th", "n", "key", "size", "words", "low", "score", "target", "k", "digest", "h", "item_id")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)


def frame(spark, texts, sources=None, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, "en", (sources or ["s0"] * len(texts))[k], len(t or ""), *["x"] * len(CLASH)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    a, b, c = prose(1, 400), prose(2, 300), prose(3, 200)
    near = a.split()
    near[50] = near[200] = "changed"
    return [a, b, None, "", "  ", a, a.replace(" ", "\n\t", 30), " ".join(near), c + " " + b, "few words", "few  words", "Few words", "é" * 50_000 + a, a.upper(), "one two three four five", "x" * 2000, None, b[:1200] + "q" + b[1200:]]


# 6


def test_exact(spark, texts):
    got = {r.doc_id: r for r in X.exact_dedup(frame(spark, texts)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [k for k, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (same[0], len(same), i == same[0], hashlib.sha256(t.encode()).hexdigest())


def test_exact_edges(spark):
    f = frame(spark, ["a", "a", "b", "b", "c"], ids=[None, 3, None, None, 3])
    got = sorted(((r.doc_id or -1), r.keep_id or -1, r.group_size, r.kept) for r in X.exact_dedup(f).collect())
    assert got == [(-1, -1, 2, False), (-1, -1, 2, False), (-1, 3, 2, False), (3, 3, 1, True), (3, 3, 2, True)]
    assert X.exact_dedup(f.where("false")).count() == 0


def test_trie_spills_whole_subtrees():
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))).encode() for _ in range(3000)]
    trie, out = X.PatriciaTrie(20_000), defaultdict(lambda: [X.NONE, 0])
    rows = [x for i, w in enumerate(words) for x in trie.insert(w, i)]
    for w, low, n in [*rows, *trie.drain()]:
        out[w] = [min(out[w][0], low), out[w][1] + n]
    assert rows and dict(out) == {w: [words.index(w), words.count(w)] for w in set(words)}


# 3


def test_urls(spark):
    urls = [None, "no host", "http://A.Example.COM/en/7x", "https://x.com/en/1", "http://com/en/", "ftp://com.net/de/8?q", "http://example.net/de/81#f", "http://notcom/en/", "http://a.org?x=/es/", "http://b.org/es/", "://", "http://x.com/fr/1", "http://x.com/fr/1"]
    f = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter(f, Q.URL_RULES).collect()}
    assert [got[k].rule for k in range(len(urls))] == [None, None, "example.com/en/7", "com/en/", "com/en/", "net/de/", "example.net/de/8", None, None, "org/es/", None, None, None]
    assert (got[2].host, got[2].path, got[2].verdict) == ("a.example.com", "/en/7x", "allow") and got[0].host == got[1].path == "" and got[0].verdict == "allow"
    assert url_filter(f.where("false"), Q.URL_RULES).count() == 0
    bad = spark.createDataFrame([(k, f"http://{'bad' if k % 2 else 'good'}.site{k % 10}.com/x", k % 2) for k in range(600)], "page_id bigint, url string, bad int")
    got = url_filter(bad, {}, outcome_col="bad").collect()
    assert all((r.verdict == "block") == r.host.startswith("bad") for r in got)


def test_rules_as_a_table(spark):
    rng = random.Random(8)
    hosts = ["com", "x.com", "a.x.com", "b.a.x.com", "y.net", "net", "x.com:80", "co", "", "a..b"]
    paths = ["/", "/e", "/en/", "/en/7", "/en/7/long", "/é", ""]
    rules = {f"{rng.choice(hosts[:8])}{rng.choice(paths[:6])}": rng.choice(["allow", "block"]) for _ in range(40)}
    urls = [f"http://{rng.choice(['', 'w.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '?q'])}" for _ in range(500)] + [None, "x"]
    f = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    table = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    few, many = (sorted(map(repr, map(tuple, url_filter(f, r).collect()))) for r in (rules, table))
    assert few == many
    lots = rules | {f"h{k}.example/p{k % 7}": "block" for k in range(3000)}
    got = {r.page_id: r for r in url_filter(f.unionByName(spark.createDataFrame([(1000, "http://w.h2999.example/p3/x")], f.schema)), lots).collect()}
    assert got[1000].rule == "h2999.example/p3" and [got[k].rule for k in range(502)] == [r.rule for r in sorted(url_filter(f, rules).collect())]


@pytest.mark.parametrize("name", ["op3_url_filter", "op6_exact_dedup"])
def test_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = Q.queries()[name](spark, SF)
    r = c.execute(Q.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, r.fetchall()))


# 4


def test_water_fill():
    assert water_fill([100, 100], [5, 2], 1.5, 2) == pytest.approx([200.0, 100.0])
    assert water_fill([10, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([20.0, 590 / 3, 295 / 3])
    assert water_fill([0, 5], [1, 1], 1.5, 2) == pytest.approx([0, 7.5]) and water_fill([], [], 1.5, 2) == []


def test_mix(spark):
    rng = random.Random(2)
    texts = [prose(k, rng.choice([0, 1, 5, 5, 40, 300])) for k in range(900)] + [None, "", "  "]
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    f = frame(spark, texts, sources)
    got = mix_sources(f).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(f.repartition(3)).collect())) and len(got) == len(texts)
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = sources[r.doc_id]
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s], target[s], most[s] = taken[s] + r.taken, r.target, max(most[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert mix_sources(f.where("false")).count() == 0


def test_mix_of_repeats(spark):
    # a third of all rows without id and of one size, and rows that repeat
    texts = ["w " * 7] * 3000 + [prose(k, 1 + k % 40) for k in range(3000)] + ["one two three"] * 500
    ids = [None] * 3000 + list(range(3000)) + [5] * 500
    f = frame(spark, texts, ["a" if k % 4 else "b" for k in range(len(texts))], ids)
    rows = mix_sources(f).collect()
    assert len(rows) == len(texts) and sorted(map(repr, rows)) == sorted(map(repr, mix_sources(f.repartition(5)).collect()))
    by = defaultdict(list)
    for r in rows:
        by[r.target].append(r)
    assert len(by) == 2 and all(abs(sum(r.taken for r in rs) - t) <= max(r["size"] for r in rs) for t, rs in by.items())
    named = f.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert sum(r.taken for r in mix_sources(named).collect()) == pytest.approx(sum(by), rel=0.001)


# 1


def test_licenses(spark):
    texts = ["MIT License, mit-license", None, "", "Licensed under the Apache License, Version 2.0.", "general PUBLIC license", "Licensed under CC BY-NC 4.0.", "license mit", "public license " * 3, prose(1, 500) + " Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "MIT License, mit-license"]
    got = {r.doc_id: r for r in license_scan(frame(spark, texts)).collect()}
    assert [(got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels) for k in range(7)] == [(4, 2, 0, 2, "mit"), (0, 0, None, None, ""), (0, 0, None, None, ""), (8, 1, 3, 3, "apache"), (3, 1, 0, 0, "gpl"), (7, 0, None, None, ""), (2, 0, None, None, "")]
    assert got[5].labels == "cc-by-nc" and got[8].labels == "bsd" and 0.6 <= got[8].score <= 1 and got[9].n_base == 2 and got[7].labels == ""
    assert license_scan(frame(spark, texts).where("false")).count() == 0


def brute_base(text):
    low = {c: c + 32 for c in range(65, 91)}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    places = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_license_base_equals_brute_force(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [*texts, "mit license " * 400, "MIT\x00LICENSE mit_license mit-licensé", "apache license general public license mit license"]
    f = docs.unionByName(spark.createDataFrame([(100_000 + k, t) for k, t in enumerate(more)] + [(None, "MIT license"), (None, "MIT license"), (None, None), (100_000, texts[0])], "doc_id bigint, text string"))
    want = sorted((repr((r.doc_id, *brute_base(r.text))) for r in f.collect()))
    got = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in license_scan(f).collect())
    assert got == want


def test_license_recall(spark):
    from quernstone.llm.license_texts import TEMPLATES

    rng, cases = random.Random(4), []
    for label, templates in TEMPLATES.items():
        for wording, _ in templates:
            words = wording.split()
            for kind in ("whole", "upper", "cut", "typo"):
                w = list(words)
                if kind == "cut" and len(w) > 40:
                    w = w[: len(w) * 4 // 5]
                if kind == "typo" and len(w) > 40:
                    for _ in range(len(w) // 20):
                        w[rng.randrange(12, len(w))] = "xyzzy"
                t = " ".join(w).upper() if kind == "upper" else " ".join(w)
                cases.append((label, kind, prose(len(cases), 40) + "\n * " + t + "\n" + prose(len(cases) + 7, 300)))
    clean = [prose(1000 + k, 300) + " the software and license of any person" for k in range(100)]
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan(frame(spark, [t for *_, t in cases] + clean)).collect()}
    found = defaultdict(list)
    for k, (label, kind, _) in enumerate(cases):
        found[kind].append(label in got[k])
    assert np.mean(found["whole"]) == np.mean(found["upper"]) == 1 and np.mean(found["cut"]) >= 0.9 and np.mean(found["typo"]) >= 0.9, {k: np.mean(v) for k, v in found.items()}
    assert all(got[len(cases) + k] == {""} for k in range(100))


def test_licenses_many_notices(spark):
    from quernstone.llm.license_texts import TEMPLATES

    one = {label: templates[-1][0] for label, templates in TEMPLATES.items()}
    combos = [list(c) for n in (1, 2) for c in itertools.combinations(sorted(one), n)] + [sorted(one)]
    texts = [" ... ".join(one[label] for label in c) for c in combos]
    texts += [" ... ".join(wording for templates in TEMPLATES.values() for wording, _ in templates)]
    combos += [sorted(one)]
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan(frame(spark, texts + [prose(k, 30) for k in range(300)])).collect()}
    assert {k: set(c) - got[k] for k, c in enumerate(combos) if set(c) - got[k]} == {}


# 5


def test_contaminated(spark):
    item = "A train of 12 wagons leaves Paris at 7 and carries 40 kg of fresh apples while Marie waits with 12 friends near the old station"
    other = item.replace("12", "15").replace("Paris", "London").replace("40 kg", "90 lb").replace("Marie", "Peter")
    torn = item.replace("12 wagons", "15 wagons").replace("Marie", "Peter")
    texts = [prose(1, 80) + ". " + item + ". " + prose(2, 80), other, torn, None, "", prose(4, 300), item.upper(), item[:30], item, item]
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "short", "x"), (10, "we five or six words here", "x")], "item_id bigint, text string, doc_id string")
    f = frame(spark, texts)
    got = {r.doc_id: r.item_ids for r in contaminated(f, bench).collect()}
    assert got == {k: [7] for k in (0, 1, 6, 8, 9)}
    clean = clean_documents(f, bench)
    assert clean.columns == f.columns and {r.doc_id for r in clean.collect()} == set(range(10)) - set(got)
    assert contaminated(f, bench.where("false")).count() == 0 and contaminated(f.where("false"), bench).count() == 0


def test_contaminated_in_other_case(spark):
    item = "A train of 12 wagons leaves Paris at 7 and carries 40 kg of fresh apples while Marie waits with 12 friends near the old station"
    german = "Der alte Bauer verkauft am Markt der Stadt 12 Körbe mit Äpfeln und die Frau kauft für ihre Straße 12 Flaschen Saft mit Zucker"
    other = item.replace("12", "15").lower()
    texts = [item.lower(), item.upper(), item.title(), german.lower(), german.upper(), other, other.replace("15", "16", 1), german]
    bench = spark.createDataFrame([(7, item), (8, german)], "item_id bigint, text string")
    got = {r.doc_id: (r.item_ids, r.best_share) for r in contaminated(frame(spark, texts), bench).collect()}
    assert got == {k: ([7], 1.0) for k in (0, 1, 2, 5)} | {k: ([8], 1.0) for k in (3, 4, 7)}


def test_contaminated_in_part(spark):
    item = "A farmer sells 12 apples and 30 pears at the market and then buys 12 plums and 7 cherries from a trader who sells 30 melons"
    head = " ".join(item.split()[:15])
    german = "Der alte Bauer verkauft am Markt der Stadt seine Körbe mit Äpfeln und die Frau kauft dort am Markt viele Flaschen Saft mit Zucker"
    start = " ".join(german.split()[:16])
    own = head + " figs or 8 nuts yet they would like some 31 cups"  # 31 stands where the item has its second 30
    inserted = item.replace("at the market", "at the big market")
    deleted = german.replace("und die Frau", "und Frau")
    torn = item.replace("12 apples", "15 apples")
    texts = [own, start + " keine Brote vom Bäcker im Dorf", inserted, deleted, head, torn, item.replace("12", "15")]
    bench = spark.createDataFrame([(7, item), (8, german)], "item_id bigint, text string")
    got = {r.doc_id: r.item_ids for r in contaminated(frame(spark, texts), bench).collect()}
    assert got == {0: [7], 1: [8], 2: [7], 3: [8], 4: [7], 6: [7]}


def brute_leaks(texts, items, min_share=0.25):
    """Contaminated texts by the rules of the operator, window by window."""
    import regex

    from quernstone.llm import decontaminate as C

    units = "|".join(sorted(C.UNITS, key=lambda u: -len(u)))

    def marked(t):
        t = regex.sub("[\x01\x02\x03]", " ", t or "")
        t = regex.sub(r"(?<=[\p{Ll},;:] )(?=\p{Lu}\p{Ll})", "\x01", t)
        t = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", t)
        t = regex.sub(rf"(?<![\p{{L}}0-9])([0-9]+)[ \t\n\x0b\f\r]?(?:({units})(?![\p{{L}}0-9]))?", lambda m: f" \x02{m[1]} \x03{m[2] or ''} ", t)
        return [w for w in regex.split(r"[\x00\x04-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w not in ("", "\x03")]

    def forms(m):
        bare = [w[1:] if w < "\x04" else w for w in m]
        return [w[0] if w < "\x04" else w for w in m], ["\x02" if w[0] == "\x02" else b.upper() for w, b in zip(m, bare, strict=True)], [b.upper() for b in bare]

    out = defaultdict(set)
    made = [(marked(t), forms(marked(t))) for t in texts]
    for item, text in items:
        m = marked(text)
        both = forms(m)
        telling = []
        for form in (0, 1):
            w = min(8, len(m))
            telling.append([a for a in range(len(m) - w + 1) if m and sum(x > "\x04" for x in both[form][a : a + w]) >= 4])
        use = [0, 1] if all(telling) else [0, 1, 2]
        for form in use:
            t = both[form]
            w = min(8, len(t))
            ats = list(range(len(t) - w + 1)) if form == 2 else telling[form]
            if not t or not ats:
                continue
            for i, (dm, df) in enumerate(made):
                d = df[form]
                starts = [0] if w == 1 and len(d) == 1 else range(len(d) - w + 1) if w > 1 else []
                where = defaultdict(list)
                for p in starts:
                    where[tuple(d[p : p + w])].append(p)
                places = defaultdict(set)
                for a in ats:
                    for p in where.get(tuple(t[a : a + w]), ()):
                        places[p - a].add(a)
                tried, chain, last = [{a: offset for a in got} for offset, got in places.items()], {}, None
                for offset in sorted(places):  # neighbouring offsets together, each window at its smallest
                    if last is not None and offset - last >= len(m):
                        tried.append(chain)
                        chain = {}
                    chain, last = {a: offset for a in places[offset]} | chain, offset
                for got in [*tried, chain] if form < 2 else tried:
                    if not got or len(got) < (len(ats) if form == 2 else min_share * len(ats)):
                        continue
                    slots = {(m[j], dm[j + k]) for a, k in got.items() for j in range(a, a + w) if m[j] < "\x04" and dm[j + k][0] == m[j][0] and (form == 0 or form == 1 and m[j][0] == "\x02")}
                    if len({x for x, _ in slots}) == len({y for _, y in slots}) == len(slots):
                        out[i].add(item)
    return dict(out)


def test_contaminated_equals_brute_force(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(6)
    kinds = {
        "upper": str.upper, "lower": str.lower, "numbers": lambda t: re.sub(r"[0-9]+", lambda m: str(int(m[0]) * 7 + 3), t), "half": lambda t: " ".join(t.split()[: len(t.split()) * 6 // 10]) + " " + prose(5, 30),
        "word": lambda t: " ".join(w if k != len(t.split()) // 2 else "other" for k, w in enumerate(t.split())),
        "spread": lambda t: " ".join(f"{w} qqxx{k}" if k % 12 == 11 else w for k, w in enumerate(t.split())),
    }
    edits = [(k, item, prose(rng.randrange(999), 60) + ". " + edit(text) + ". " + prose(rng.randrange(999), 60)) for k, edit in kinds.items() for item, text in bench]
    texts = [*docs, *[t for *_, t in edits], None, "", *[prose(3000 + k, 80) for k in range(50)]]
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {r.doc_id: set(r.item_ids) for r in contaminated(frame(spark, texts), b).collect()}
    assert got == brute_leaks(texts, bench)
    recall = {k: np.mean([item in got.get(len(docs) + i, ()) for i, (kind, item, _) in enumerate(edits) if kind == k]) for k in kinds}
    assert min(recall.values()) >= 0.9, recall
    assert not [i for i in got if i >= len(docs) + len(edits)]


def test_contaminated_with_words_put_in(spark):
    """A whole item with a foreign word after every few words, or every few words left out, over many offsets."""
    item = prose(77, 100)
    words = item.split()
    put = lambda n: " ".join(f"{w} foreign{k}" if k % n == n - 1 else w for k, w in enumerate(words))
    left = lambda n: " ".join(w for k, w in enumerate(words) if k % n != n - 1)
    texts = [put(n) for n in (20, 25, 33, 50)] + [left(n) for n in (20, 25)] + [put(6), " ".join(words[:20]), " ".join(words[40:56]) + " " + prose(3, 150) + " " + " ".join(words[:16])]
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r.doc_id: r.best_share for r in contaminated(frame(spark, texts), bench).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5}  # short quotations, and pieces too far apart, stay below the share
    assert got[0] > 0.6 and got[1] > 0.7


def test_contaminated_classes_and_nulls(spark):
    """A template with many fillings is one class; rows and items without ids."""
    say = "A farmer sells {} apples and {} pears at the market and then buys {} plums from a trader there"
    bench = [(k, say.format(k + 10, 2 * k + 11, 3 * k + 500)) for k in range(300)] + [(None, "Which of the old stone bridges over the river was built by monks")]
    texts = [say.format(5, 6, 9), say.format(5, 5, 9), "which of the old stone bridges over the river was built by monks", None, say.format(5, 6, 9)]
    f = frame(spark, texts, ids=[1, 2, 3, None, None])
    got = sorted((r.doc_id or -1, r.item_ids, r.best_share) for r in contaminated(f, spark.createDataFrame(bench, "item_id bigint, text string")).collect())
    assert got == [(-1, [0], 1.0), (1, [0], 1.0), (3, [], 1.0)]


def test_contaminated_by_short_items(spark):
    items = ["What is 7 times 8?", "Who wrote Hamlet?", "12 15 18 21 24 27 30 33 36 39", "Paris"]
    texts = ["And then: " + items[0] + " Nobody knew.", "what is 7 TIMES 8", "What is 7 times 9?", "we ask who wrote hamlet today", "who wrote", "12 15 18 21 24 27 30 33 36 39 42", "12 15 18 21 24 27 30 33 36", "a week in Paris with friends", "paris!"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: r.item_ids for r in contaminated(frame(spark, texts), bench).collect()}
    assert got == {0: [0], 1: [0], 3: [1], 5: [2], 8: [3]}


# 7


@pytest.fixture(scope="module")
def tokenizer():
    return Q.tokenizer_path()


def test_pieces_equal_whole_texts(tokenizer):
    e, rng = H.Encoder(tokenizer, 50), random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice(["a", "B", "'s", "'", "9", "²", " ", " ", "\n", "\t", ".", ",!", "é", "日", "\xa0", "<|endoftext|>"]) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(e(s), "<u2").tolist() == e.tok.encode(s, add_special_tokens=False).ids, repr(s)


def test_tokens(spark, texts, tokenizer):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    got = sorted(map(tuple, H.token_output(frame(spark, texts), tokenizer, block_ids=300).collect()))
    at, want = 0, []
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert H.token_output(frame(spark, texts).where("false"), tokenizer).count() == 0


def test_counts_come_with_the_ids(tokenizer):
    """One pass gives the ids and how often each comes, and a piece is made once whatever stands beside it."""
    import pyarrow as pa

    words = ["alpha", "beta,", "gamma.\nDelta", "(alpha)", "beta."]
    made = [f"{a} {b}" for a in words for b in words]
    *parts, last = H._to_ids(tokenizer, 2)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(made))), pa.array(made)], names=["doc_id", "text"])]))
    ids = np.concatenate([H._unpacked(x, 2) for p in parts for x in p.column(1).to_pylist()])
    assert (np.frombuffer(last.column(2)[0].as_py(), "<i8") == np.bincount(ids)).all() and last.column(1)[0].as_py() is None
    encoder, seen = H.Encoder(tokenizer), []
    encoder.pieces.make = lambda p: seen.append(p) or encoder._piece(p)
    assert [encoder(t) for t in made] == [encoder.whole(t) for t in made]
    assert len(seen) == len(set(seen)) and set(vars(encoder)) & {"spaced"} == set()


def test_tokens_of_other_files_and_ids(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert not H.Encoder(path, 50).cuts and H.Encoder(Q.tokenizer_path(), 50).cuts
    tok = Tokenizer.from_file(path)
    texts = [t for t in texts if t is None or len(t) < 5000]
    ids = [None, None, 7, 7, *range(20, 16 + len(texts))]
    got = sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in H.token_output(frame(spark, texts, ids=ids), path).collect())))
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert got == sorted(repr((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))) for i, x in zip(ids, want, strict=True))


def test_codes():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 4), (2, 4), (16, 4), (3000, 12), (3000, 16)):
        counts = np.maximum(1, (1e9 / (1 + np.arange(n)) ** 3).astype(np.int64))
        bits = H.code_lengths(counts, limit)
        assert bits.max() <= limit and (2.0 ** -bits.astype(float)).sum() <= 1
        ids = rng.integers(0, n, 1000)
        stream, marks = H.encode_block(ids, H.canonical_codes(bits), bits)
        assert H.decode_blocks([(stream, marks, 1000)], H.decode_table(bits, limit), limit)[0].tolist() == ids.tolist()
    assert H.code_lengths(np.array([1, 1, 2, 4]), 4).tolist() == [3, 3, 2, 1]


# 8


def brute_spans(texts):
    where = defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for i, b in enumerate(data):
        for s in range(len(b) - D.WIDTH + 1):
            where[b[s : s + D.WIDTH]].append((i, s))
    cover = [np.zeros(len(b), bool) for b in data]
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s : s + D.WIDTH] = True
    return data, cover


def test_repeats(spark, texts, monkeypatch):
    texts = [t[:9000] if t else t for t in texts] + ["ab" * 500, prose(9, 60) + prose(2, 300)[100:700] + prose(10, 90), prose(9, 20) + prose(2, 300)[99:640]]
    data, cover = brute_spans(texts)
    for piece in (1 << 18, 700):
        monkeypatch.setattr(D, "SLICE", piece)
        got = {r.doc_id: r for r in D.remove_repeats(frame(spark, texts)).collect()}
        for i, (b, c) in enumerate(zip(data, cover, strict=True)):
            kept = bytes(np.frombuffer(b, np.uint8)[~c]) if b else b""
            runs = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(c.sum()), runs, hashlib.sha256(kept).hexdigest()), i
    assert D.remove_repeats(frame(spark, texts).where("false")).count() == 0


def test_repeats_without_ids(spark):
    a, b = prose(41, 200), prose(42, 100)
    f = frame(spark, [a, a, b, prose(43, 90) + "|" + a[100:700], None], ids=[None, None, None, 4, 4])
    got = sorted((r.doc_id or -1, r.n_removed, r.has_repeats, round(r.removed_share, 6)) for r in D.remove_repeats(f).collect())
    n, whole = len(prose(43, 90)) + 601, len(a)
    assert got == [(-1, 0, False, 0.0), (-1, whole, True, 1.0), (-1, whole, True, 1.0), (4, 0, False, 0.0), (4, 600, True, round(600 / n, 6))]


# 9


def brute_components(texts):
    low = {c: c + 32 for c in range(65, 91)}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 75 * (len(x) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [(len(x), top(i), top(i) == i) for i, x in enumerate(sets)]


def test_near(spark, texts, monkeypatch):
    base, rng = prose(20, 120).split(), random.Random(3)
    copies = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(99)
        copies.append(" ".join(w))
    shared = prose(30, 40)
    texts = [*texts, *copies, *[shared + " " + prose(100 + k, 12) for k in range(40)]]
    for small in (48, 3):
        monkeypatch.setattr(M, "SMALL", small)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(frame(spark, texts)).collect()}
        assert got == dict(enumerate(brute_components(texts)))
    assert M.near_duplicates(frame(spark, texts).where("false")).count() == 0


def test_near_null_ids(spark):
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in M.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", "", "z"], ids=[None, 5, None, None])).collect())
    assert got == [(-1, -1, False), (-1, -1, True), (-1, 5, False), (5, 5, True)]


def test_near_copies_without_ids(spark):
    w = prose(51, 60).split()
    near = " ".join([*w[:30], "x", *w[31:]])
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in M.near_duplicates(frame(spark, [" ".join(w), near, near + " y", prose(52, 60)], ids=[None, None, 9, None])).collect())
    assert got == [(-1, -1, False), (-1, 9, False), (-1, 9, False), (9, 9, True)]


def test_near_in_a_hot_group(spark, monkeypatch):
    """Texts that share most, but not enough, of their shingles with all others, and copies among them."""
    shared, rng = prose(60, 70), random.Random(1)
    texts = [shared + " " + prose(200 + k, 14) for k in range(70)]
    texts += [t.replace(t.split()[rng.randrange(70, 80)], "edit") for t in texts[:25]]
    rng.shuffle(texts)
    monkeypatch.setattr(M, "SMALL", 4)
    monkeypatch.setattr(M, "BLOCK", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_near_copies_of_one_original(spark, monkeypatch):
    """Copies near to their original, not to each other, the least id a copy's: compared pairs grow with the group, not with its square."""
    words, rng = prose(61, 260).split(), random.Random(2)
    original, texts = list(words), []
    for k in range(90):
        at = rng.sample(range(2, 258, 6), 6)
        texts.append(" ".join(f"edit{k}" if i in at else w for i, w in enumerate(original)))
    texts.append(" ".join(original))
    compared, near = [], M._near

    def counted(pairs, reps):
        compared.append(pairs.count())
        return near(pairs, reps)

    monkeypatch.setattr(M, "_near", counted)
    got = M.near_duplicates(frame(spark, texts)).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(compared) < 12 * len(texts)


def test_near_pivots_of_one_bucket(spark, monkeypatch):
    """A class whose component has had a pivot isn't paired again, and pivots that find hardly a link are not followed by more."""
    words, rng = prose(63, 130).split(), random.Random(4)
    texts = [" ".join(f"edit{k}" if i in (7 + k, 80) else w for i, w in enumerate(words)) for k in range(40)]
    texts += [" ".join([*words[:90], *prose(300 + k, 40).split()]) for k in range(40)]  # alike, but no links
    rng.shuffle(texts)
    paired, stars = [], M._stars

    def counted(at, pivots):
        out = stars(at, pivots)
        paired.append(out.count())
        return out

    monkeypatch.setattr(M, "SMALL", 4)
    monkeypatch.setattr(M, "_stars", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))
    assert len(paired) <= 2 and sum(paired) < 5 * len(texts)


def test_a_word_longer_than_a_slice(monkeypatch):
    from quernstone.llm import shingles as S

    texts = ["a b " + "x" * 9000 + " c d e f " + prose(1, 300), "y" * 5000, prose(2, 900)]
    whole = S.shingle_sets(texts)
    monkeypatch.setattr(S, "SLICE", 1000)
    assert all((a == b).all() for a, b in zip(whole, S.shingle_sets(texts), strict=True))


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(500, 700), (700, 600), (900, 900)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 600: 500, 700: 500}


def test_further_links_join_components(spark):
    at = lambda pairs: spark.createDataFrame(pairs, "a bigint, b bigint")
    first, more = [(1, 4), (4, 6), (2, 5), (8, 9)], [(6, 5), (7, 3), (7, 9)]
    got = {r.id: r.component for r in M._joined(components(at(first)), at(more)).collect()}
    assert got == {r.id: r.component for r in components(at(first + more)).collect()} == {1: 1, 4: 1, 6: 1, 2: 1, 5: 1, 8: 3, 9: 3, 3: 3, 7: 3}


def test_components_of_a_star(spark, monkeypatch):
    """A star goes in two rounds, however many leaves it has."""
    tags, written = [], C.written
    monkeypatch.setattr(C, "written", lambda df, tag: (tags.append(tag), written(df, tag))[1])
    star = [(k, 1000) for k in range(2000) if k != 1000]
    assert {(r.id, r.component) for r in components(spark.createDataFrame(star, "a bigint, b bigint")).collect()} == {(k, 0) for k in range(2000)}
    assert tags.count("follow") <= 2


# 2 and 10


def test_ordinal_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5)).astype(np.float32)
    s = x @ np.array([2, -1, 0.5, 0, 0]) + rng.logistic(size=1500)
    y = np.digitize(s, [-1.5, 1.0])
    m = fit_ordinal(x, y)
    assert m.thresholds[0] < m.thresholds[1] and (np.abs(np.round(m.expected(x)) - y) <= 1).mean() > 0.95
    assert np.allclose(m.tails(x)[:, 0] >= m.tails(x)[:, 1], True)


def test_quality(spark, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from quernstone.llm.quality import quality_grade

    model = fit_quality(docs, labels.select("doc_id", quality_grade().alias("grade")))
    f = frame(spark, texts).withColumn("expected_grade", F.lit("x"))
    got = score_quality(f, model).collect()
    assert len(got) == len(texts) and all(0 <= r.accept_probability <= 1 for r in got)
    assert isinstance(got[0].expected_grade, float)
    none = fit_quality(docs, labels.where("false").select("doc_id", F.lit(1).alias("grade")))
    assert isinstance(none, Ordinal) and all(r.accept_probability == 1 for r in score_quality(f, none).collect())
    kept = [r for r in Q.op2_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()]
    good, bad = ([r.kept for r in kept if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and len(bad) > 30 and np.mean(bad) < 0.1
    assert score_quality(f.where("false"), model).count() == 0


def test_quality_held_out(spark):
    """Accepted or not, on rows that weren't learned from."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from quernstone.llm.quality import quality_grade

    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit_quality(docs, labels.where(~held).select("doc_id", quality_grade().alias("grade")))
    got = score_quality(docs, model).join(labels.where(held), "doc_id").select("accept_probability", "quality").collect()
    right = {q: np.mean([(r.accept_probability >= Q.ACCEPT) == bool(q) for r in got if r.quality == q]) for q in (0, 1)}
    assert len(got) > 1000 and min(right.values()) > 0.97, right


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = Q.op10_toxicity(spark, d).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert len(got) > 1000 and hit / sum(r.toxic for r in got) >= 0.9 and hit / sum(r.predicted for r in got) >= 0.95


def test_quality_of_repeated_ids(spark):
    from quernstone.llm.quality import sample_texts

    docs = spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (2, None, "x"), (None, "c", "x"), (3, "d", "x")], "doc_id bigint, text string, grade string")
    sample = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (9, 1)], "doc_id bigint, grade int")
    assert sorted(map(tuple, sample_texts(docs, sample, "doc_id", "text").collect())) == [(1, 0, "a"), (1, 1, "a"), (2, 1, "")]


def test_scoring_takes_memory_for_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from quernstone.llm.quality import WIDTH, _score, features

    rng = np.random.default_rng(5)
    model = Ordinal(rng.normal(0, 5, WIDTH).astype(np.float32), np.array([0.0, 1.0]))
    said = [prose(k, 30) if k % 50 else None for k in range(500)]
    rows = pa.record_batch([pa.array(said)], names=["text"])
    run = _score(model, 0, 1, ("grade", "tail"))
    list(run(iter([rows])))
    tracemalloc.start()
    try:
        got = [x for out in run(iter([rows])) for x in out.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = model.tails(np.stack([features(t) for t in said]).astype(np.float64))
    assert np.allclose([(x["grade"], x["tail"]) for x in got], np.stack([want.sum(1), want[:, 0]], 1), rtol=0, atol=1e-12)
    assert peak < 4_000_000, peak


def test_small_tables_start_no_further_workers(spark, tokenizer, monkeypatch):
    """Lists of rows go through an RDD of pickles, for which executors keep a second set of Python workers."""
    import pyarrow as pa
    from pyspark import SparkContext

    import corpus_pipeline as P
    from quernstone.llm.common import small_table, table

    def refused(*_, **__):
        raise AssertionError("an RDD of Python's")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    kinds = [("source", pa.string()), ("k", pa.int32())]
    assert [tuple(r) for r in small_table(spark, [(None, 1), ("a", None)], kinds).collect()] == [(None, 1), ("a", None)]
    assert small_table(spark, [], kinds).dtypes == [("source", "string"), ("k", "int")] and not small_table(spark, [], kinds).collect()
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    for name, stage in P.STAGES:
        if name != "minhash_near_dedup":
            assert stage(spark, docs, d).count(), name


def test_bit_offsets_have_64_bits():
    ids = np.arange(300) % 7
    bits = H.code_lengths(np.bincount(ids), 16)
    assert H.encode_block(ids, H.canonical_codes(bits), bits)[1].dtype == np.int64


def test_isotonic_and_trees():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]
    rng = np.random.default_rng(0)
    z = rng.normal(size=(800, 3))
    t = ((z[:, 0] > 0.3) & (z[:, 1] < 0.5)).astype(float)
    assert (((fit_trees(z, t).raw(z) > 0) == t) .mean()) > 0.97


def test_toxicity(spark, texts):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = Q.op10_toxicity(spark, d).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = fit_toxicity(docs, spark.createDataFrame([(k, v) for k, v in labels.items()], "doc_id bigint, label int"))
    out = toxicity(frame(spark, texts), model).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    none = fit_toxicity(docs, spark.createDataFrame([], T.StructType.fromDDL("doc_id bigint, label int")))
    assert {r.score for r in toxicity(frame(spark, texts), none).collect()} == {0.0}
    assert toxicity(frame(spark, texts).where("false"), model).count() == 0
    assert toxicity(frame(spark, texts[:3], ids=[None, None, 1]), model).count() == 3
    few = fit_toxicity(docs, spark.createDataFrame([(k, v) for k, v in list(labels.items())[:12]] + [(None, 1)], "doc_id bigint, label int"))
    assert all(0 <= r.score <= 1 for r in toxicity(frame(spark, texts), few).collect())


def test_shared_folder():
    from types import SimpleNamespace as N

    from quernstone.llm import common

    jsc = N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))
    fake = N(conf=N(get=lambda *_: None), sparkContext=N(_jsc=jsc, master="spark://host:7077", applicationId="fake"))
    with pytest.raises(ValueError):
        common.shared_dir(fake)


def test_scratch_per_thread(spark):
    import threading

    from quernstone.llm.common import Scratch, written

    with Scratch() as s:
        t = threading.Thread(target=lambda: seen.append(written(spark.range(3), "other")))
        seen = []
        t.start()
        t.join()
        own, kept = written(spark.range(4), "own"), s.keep(written(spark.range(5), "kept"))
    assert seen[0].count() == 3 and kept.count() == 5
    with pytest.raises(Exception):
        own.count()


# the pipeline


def test_pipeline(spark, tokenizer):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from quernstone.llm.common import table
    from quernstone.llm.quality import features

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    after = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.schema.names == docs.schema.names, name
        before = sorted(docs.collect())
        docs = P.written(out, "test-stage")
        after[name] = (before, sorted(docs.collect()))
    # every stage by brute force on what it was given
    from quernstone.llm.quality import quality_grade

    model = fit_quality(table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", quality_grade().alias("grade")))
    given, got = after["quality_classifier"]
    tails = [model.tails(features(r.text)[None, :].astype(np.float64))[0, 0] for r in given]
    assert got == [r for r, t in zip(given, tails, strict=True) if t >= Q.ACCEPT] and 0 < len(got) < len(given)
    given, got = after["minhash_near_dedup"]
    assert got == [r for r, (_, _, kept) in zip(given, brute_components([r.text for r in given]), strict=True) if kept] and len(got) < len(given)
    given, got = after["benchmark_decontamination"]
    bad = brute_leaks([r.text for r in given], [(r.item_id, r.text) for r in table(spark, d, "benchmark").collect()])
    assert got == [r for k, r in enumerate(given) if k not in bad] and bad
    given, got = after["source_mix"]
    size, source, want = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), sorted({r.source for r in given}), {}
    totals = [sum(size(r) for r in given if r.source == s) for s in source]
    for s, target in zip(source, water_fill(totals, [(5, 2, 1)[i % 3] for i in range(len(source))], 1.5, 2), strict=True):
        assert abs(sum(size(r) for r in got if r.source == s) - target) <= max(size(r) for r in given if r.source == s)
    assert set(got) <= set(given) and max(got.count(r) for r in got) <= 2
    tok, at = Tokenizer.from_file(tokenizer), 0
    for r in got:
        want.setdefault(r.doc_id, []).append([*tok.encode(r.text or "", add_special_tokens=False).ids, 2])
    last = P.run(spark, d)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(last.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [r.doc_id for r in got]
    for r in rows:
        ids = want[r.doc_id].pop()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pipeline_edges(spark):
    """Null, empty, repeated ids and rows, clashing columns; empty tables; every stage keeps the columns."""
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    good = [r.text for r in P.table(spark, d, "documents").where("lang = 'en' and n_chars between 500 and 3000").limit(12).collect()]
    texts = [*good, good[0], good[1], None, "", "  ", good[2], None]
    ids = [*range(9), 3, 3, None, 7, None, 20, 21, 22, 2, None]
    f = frame(spark, texts, ids=ids)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, f, d)
        assert out.columns == f.columns and stage(spark, f.where("false"), d).count() == 0, name
        rows = out.select("doc_id", "text").collect()
        assert set(map(tuple, rows)) <= set(zip(ids, texts, strict=True))
        if name == "minhash_near_dedup":  # one row for each distinct text with words, whatever the ids; rows without words stay
            want, n, low = brute_components(texts), 0, {}
            for k, (size, c, _) in enumerate(want):
                if size:
                    low[c] = min(low.get(c, (True, 0)), (ids[k] is None, ids[k] or 0))
                else:
                    n += 1
            assert len(rows) == len(low) + n
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows if r.text and r.text.strip()) == sorted(low.values())
        if name == "source_mix":
            words = sum(len((t or "").split()) for t in texts)
            assert abs(sum(len((r.text or "").split()) for r in rows) - 1.5 * words) <= max(len(t.split()) for t in good)
    assert P.STAGES[-1][1](spark, f, d).count() == len(texts) and P.STAGES[-1][1](spark, f.where("false"), d).count() == 0
