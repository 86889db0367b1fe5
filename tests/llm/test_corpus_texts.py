import math
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from blockflow.llm import backoff, licences, lines, quadratic, sanitise, warc
from blockflow.llm.common import crc_remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_base_score_is_the_add_one_estimate(spark, small, edge_docs, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(
        edge_docs.select("doc_id", "text"))
    words = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.collect()]
    held = {i: i is not None and crc_remainder(i, 7) == 2 for i, _ in words}
    counts = Counter(w for i, ws in words if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted((i if i is not None else -1, held[i], len(ws), sum(w in counts for w in ws),
                       round(sum(math.log10((counts[w] + 1) / (total + distinct + 1))
                                 for w in ws), 5)) for i, ws in words)
    rows = backoff.score(docs).collect()
    assert expected == sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens,
                               r.n_known, round(r.base_score, 5)) for r in rows)
    assert {r.train_tokens for r in rows} == {total}
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert backoff.score(no_docs).count() == 0


def brute_model(texts):
    """Probability of a token after a context by recursion over plain counts of all texts."""
    grams = Counter()
    for text in texts:
        words = [b"", *text, b""]
        for i in range(1, len(words)):
            grams[words[i],] += 1
            grams[words[i - 1], words[i]] += 1
            if i > 1:
                grams[tuple(words[i - 2:i + 1])] += 1
    total = sum(n for g, n in grams.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in grams)

    def p(context, word):
        if not context:
            return (grams[word,] + 1) / (total + distinct + 1)
        strength = backoff.STRENGTHS[len(context) - 1]
        return ((grams[(*context, word)] + strength * p(context[1:], word))
                / (grams[context] + strength))

    def log_p(text):
        words = [b"", *text, b""]
        return sum(math.log10(p(tuple(words[max(0, i - 2):i]), words[i]))
                   for i in range(1, len(words)))

    return p, log_p, {w for g in grams for w in g}


def test_automaton_equals_the_plain_recursion(spark, small, edge_docs, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(
        edge_docs.select("doc_id", "text"))
    monkeypatch.setattr(backoff, "PART", 5_000)  # many parts
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    _, log_p, _ = brute_model(w for i, w in texts if i is None or crc_remainder(i, 7) != 2)
    expected = sorted((-1 if i is None else i, round(log_p(w), 4)) for i, w in texts)
    rows = sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 4))
                  for r in backoff.score(docs.repartition(7)).collect())
    assert [i for i, _ in rows] == [i for i, _ in expected]
    assert all(abs(a - b) < 1e-3 for (_, a), (_, b) in zip(rows, expected, strict=True))


def test_probabilities_sum_to_one():
    """After any context the next token's probabilities, with one unseen word, add up to 1."""
    p, _, words = brute_model([t.split() for t in (b"a b c a b d", b"a b c", b"b c c", b"")])
    for context in ((), (b"",), (b"a",), (b"a", b"b"), (b"", b"a"), (b"d", b"d"), (b"x",)):
        assert abs(sum(p(context, w) for w in [*words, b"unseen"]) - 1) < 1e-9


def test_model_grows_with_the_corpus(spark):
    """Four times the text with new pairs has four times the pairs: nothing is cut off."""
    def grams(n):
        docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id, ' v', id, ' u', id) as text")
        told = backoff.totals(backoff.blocks(docs), 4 * n)
        return told.filter("kind = 1").agg(F.sum("n_distinct")).first()[0]

    few, many = grams(500), grams(2000)
    assert 3.8 < many / few < 4.2


def brute_lines(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    rows = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(rows) - len(set(rows)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_line_figures(spark, small, edge_docs, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(
        edge_docs.select("doc_id", "text"))
    for r in lines.clean(docs, ["doc_id", "text"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == brute_lines(r.text)
        assert not (r.base_failed and r.kept)
    assert lines.clean(no_docs, ["doc_id"]).count() == 0


def test_line_rules(spark):
    good = "A whole sentence of plain prose that ends as it should, with a full stop."
    bad = ["Home | About | Contact | Help", "Home About Login", "All rights reserved.",
           "SHOUTING LINE OF MANY WORDS THAT NOBODY LIKES", "too short", "### *** $$$ %%% word"]
    rows = [(i, x, F) for i, x in enumerate([good, *bad])]
    frame = spark.createDataFrame([(i, f"{good}\n{x}\n{good} Once more, it goes on.")
                                   for i, x, _ in rows], "doc_id long, text string")
    found = {r.doc_id: r for r in lines.clean(frame, ["doc_id"]).collect()}
    assert found[0].n_bad_lines == 0
    assert all(found[i].n_bad_lines == 1 and bad[i - 1] not in found[i].clean_text
               for i in range(1, 7))
    mostly = spark.createDataFrame([(0, good + "\n" + "\n".join(bad * 4))],
                                   "doc_id long, text string")
    assert not lines.clean(mostly, ["doc_id"]).first().kept


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quadratic.op4_quality(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    poor = [r.score for r in rows if r.quality == 0]
    better = sum((g > p) + 0.5 * (g == p) for g in good for p in poor)
    assert better / len(good) / len(poor) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_of_odd_rows(spark, edge_docs, no_docs):
    x = edge_docs.select("doc_id", quadratic.statistics(F.col("text")).alias("x"))
    assert all(len(r.x) == quadratic.STATISTICS and all(map(math.isfinite, r.x))
               for r in x.collect())
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (4, 0), (5, 1), (5, 1)],
                                   "doc_id long, quality int")
    model = quadratic.fit(quadratic.with_labels(x, labels))
    scores = x.select(quadratic.score(model, F.col("x")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in scores)
    assert quadratic.fit(quadratic.with_labels(x, labels.limit(0))) is None
    assert quadratic.fit(no_docs.select(F.lit(1).alias("label"), F.array().alias("x"))) is None


def test_personal_data_of_odd_texts(spark, edge_docs, no_docs):
    texts = ["mail a.b@c.de, x@y and p_q@r.st_u@v.wx.", "10.0.0.255 10.0.0.256 1.2.3.4.5.6.7.8",
             "4539 1488 0343 6467 and 4539-1488-0343-6468 5", "+1 (234) 555-1234 +12 +(1)",
             "é a@b.cd é", "@" * 2000, "1." * 3000, "+1" * 3000, "a" * 100_000 + "@b.c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(
        edge_docs.select("doc_id", "text"))
    got = sanitise.find_spans(frame, ["doc_id", "text"]).collect()
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
                "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, match):
        digits = [int(c) for c in match if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            twice = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
            return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    for r in got:
        if len(r.text or "") > 50_000:  # quadratic for the plain patterns
            continue
        expected = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns.values())
                          for m in re.finditer(p, r.text or "")
                          if valid(list(patterns)[k], m.group()))
        assert [(x.s, x.k, x.e) for x in r.base] == expected
    assert sanitise.find_spans(no_docs, ["doc_id"]).count() == 0


def test_revealing_terms_go_everywhere(spark):
    around = ["write Zorblatt today", "call Zorblatt again", "for Zorblatt only", "says Zorblatt twice"]
    rows = [f"The clerk said {w} at zor@blatt.org, and that is well." for w in around]
    rows += ["Copied Flimmer line with flim@mer.org in it."] * 6  # one context only
    rows += [f"The clerk said on day {i} that and at the contact is well." for i in range(40)]
    rows += ["Nobody saw Zorblatt on the bridge.", "Nobody saw the clerk on the bridge."]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {(r.term, r.entity) for r in sanitise.revealing_terms(docs).collect()} == {
        ("zorblatt", "0:zor@blatt.org")}
    found = {r.doc_id: r for r in sanitise.find_spans(docs, ["doc_id"]).collect()}
    assert [(x.s, x.e) for x in found[50].spans] == [(11, 19)]
    assert not found[51].spans and not found[20].spans and len(found[5].spans) == 1
    hidden = {r.doc_id: r.text for r in sanitise.hide_personal_data(spark, docs, "").collect()}
    assert hidden[50] == "Nobody saw [NAME] on the bridge."
    assert "zor@blatt.org" not in hidden[0] and "[EMAIL]" in hidden[0]
    assert hidden[51] == rows[51]


def test_revealing_terms_with_the_same_neighbours(spark):
    """Different lines count, also where a term always stands between the same two."""
    rows = [f"Contact number {i} of Zorblatt is zor@blatt.org, said the clerk." for i in range(5)]
    rows += [f"Flimmer Smith flim@mer.org, room {i}" for i in range(3)]
    rows += ["Copied Drumlin line with drum@lin.org in it."] * 6  # one line only
    rows += [f"The clerk said on day {i} that the contact is well, in a room." for i in range(40)]
    rows += ["Nobody saw Zorblatt on the bridge.", "Nobody saw the clerk on the bridge."]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {(r.term, r.entity) for r in sanitise.revealing_terms(docs).collect()} == {
        (t, "0:zor@blatt.org") for t in ("zorblatt", "number", "of")} | {
        (t, "0:flim@mer.org") for t in ("flimmer", "smith")}
    hidden = {r.doc_id: r.text for r in sanitise.hide_personal_data(spark, docs, "").collect()}
    assert hidden[54] == "Nobody saw [NAME] on the bridge." and hidden[55] == rows[55]
    assert "Flimmer" not in hidden[5] and "Drumlin" in hidden[8]


def test_licences(spark, edge_docs, no_docs):
    cases = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
             "All rights reserved.": "", "The MIT campus is large.": "",
             "Licensed under the Foo License.": "", "You need a fishing license.": ""}
    frame = spark.createDataFrame([(i, f"Some text.\n{t}") for i, t in enumerate(cases)],
                                  "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan(frame, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    odd = licences.scan(edge_docs, ["doc_id", "text"]).collect()
    assert all(r.families == "" and r.n_confirmed == 0 for r in odd)
    assert all(r.n_paragraphs == 0 for r in odd if not (r.text or "").strip())
    assert licences.scan(no_docs, ["doc_id"]).count() == 0


def test_wrapped_licences(spark):
    """Notices over several lines, in comments too; versions and AGPL are told apart."""
    openings = licences.OPENINGS
    wrapped = {f: "\n".join(" * " + x for x in textwrap.wrap(openings[f][0], 72))
               for f in ("BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MIT")}
    cases = [(t, f) for f, t in wrapped.items()]
    cases += [(f"Some text before it\n{t}\nand after it", f) for f, t in wrapped.items()]
    cases += [(wrapped["ISC"] + "\n" + wrapped["BSD-3-Clause"], "BSD-3-Clause,ISC"),
              (wrapped["GPL-3.0"].replace("GNU General", "GNU Affero General"), ""),
              ("Licensed under the GNU Affero General Public License, version 3.", ""),
              ("Under the GNU General Public License.", ""),
              ("Licensed under the MIT License.\nLicensed under the Apache License 2.0.",
               "Apache-2.0,MIT")]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)],
                                  "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(frame, ["doc_id"]).collect()}
    assert [(t, got[i].families) for i, (t, _) in enumerate(cases)] == cases
    assert all(got[i].n_unknown == 0 for i in range(len(wrapped)))


def test_licence_scores_by_hand(spark):
    """The native sums against a plain softmax over the same weights."""
    model = licences.classifier()
    texts = [s for _, s in licences.notices()[::7]]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select("text", licences.paragraphs(F.col("text")).alias("p")).collect():
        z = [sum(v) + b for v, b in zip(zip(*[model.weights[g] for g in licences.grams(r.text)
                                             if g in model.weights], strict=True), model.bias,
                                        strict=True)]
        top = max(z)
        p = 1 / sum(math.exp((v - top) / licences.SCALE) for v in z)
        assert r.p[0].family == model.families[z.index(top)]
        assert abs(r.p[0].probability / licences.SCALE - p) < 1e-5


def test_warc_records(spark, small, tmp_path):
    pages = spark.createDataFrame(
        [(0, "http://a/", "<html><head><title>T &amp; t</title><script>var x='<p>no</p>'</script>"
          "</head><body><!-- c --><p>One&nbsp;two<br>three</p><a href=\"/l\">link</a>"),
         (1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<script>never closed")],
        "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    rows = warc.derive(warc.responses(pages), "page_id").collect()
    assert len(rows) == 10
    text = [r for r in rows if r.page_id == 0 and r.record_type == "conversion"][0]
    meta = [r for r in rows if r.page_id == 0 and r.record_type == "metadata"][0]
    assert text.block == "One two\nthree\nlink"
    assert text.refers_to == meta.refers_to and text.record_id in meta.block
    assert "title: T & t\r\n" in meta.block and "outlink: /l" in meta.block
    assert "sourceHeader: HTTP/1.1 200 OK" in meta.block
    assert text.source_payload_digest in meta.block
    warc.write_warc(warc.derive(warc.responses(pages), "page_id"), str(tmp_path / "out"))
    import gzip
    found = []
    for f in (tmp_path / "out").glob("*.gz"):
        raw = gzip.decompress(f.read_bytes())
        while raw:
            header, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in header.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            found.append((fields[b"WARC-Type"].decode(), rest[:n].decode()))
            assert rest[n:n + 4] == b"\r\n\r\n"
            raw = rest[n + 4:]
    assert sorted(found) == sorted((r.record_type, r.block) for r in rows)
    empty = warc.derive(warc.responses(pages.limit(0)), "page_id")
    assert empty.count() == 0


def test_many_matches_in_one_text(spark):
    """Places of matches over many blocks of one text, in a time that is not quadratic."""
    counts = [0, 1, 255, 256, 257, 513, 20_000]
    docs = spark.createDataFrame(
        [(n, " ".join(f"ü a{i}@b.org" for i in range(n))) for n in counts],
        "doc_id long, text string")
    for r in docs.select("doc_id", "text", sanitise.base_spans(F.col("text")).alias("x")).collect():
        expected = [m.span() for m in re.finditer(r"a[0-9]+@b\.org", r.text)]
        assert [(x.s, x.e) for x in r.x] == expected and len(expected) == r.doc_id


def test_flags_of_terms_are_no_constant_of_the_plan(spark, monkeypatch):
    """The driver keeps the text of each plan, so a table of flags must not stand in it."""
    sizes, write = [], sanitise.checkpointed

    def seen(df):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df)

    monkeypatch.setattr(sanitise, "checkpointed", seen)
    rows = [f"{w} Zorblatt zor@blatt.org" for w in ("write", "call", "for", "says")]
    rows += ["Nobody saw Zorblatt.", "Nobody saw the clerk."] + [f"day {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in sanitise.find_spans(docs, ["doc_id"]).collect()}
    assert [(x.s, x.e) for x in found[4]] == [(11, 19)] and not found[5]
    assert len(sizes) == 4 and max(sizes) < 100_000


def test_flags_stand_at_the_places_of_all_terms(spark):
    terms = spark.range(5000).select(F.col("id").cast("string").alias("term"))
    places = {r[0] for r in terms.select(sanitise._place(F.col("term"))).collect()}
    flags = sanitise._flags(terms).first().flags
    assert len(flags) == sanitise.FLAGS // 64
    assert {64 * i + b for i, x in enumerate(flags) for b in range(64) if x >> b & 1} == places
    assert not any(sanitise._flags(terms.limit(0)).first().flags)
