import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import awkward_rows, empty, frame
from trendlens.llm import langid, licenses, pii, quality_crf

SF = "/root/testdata/sf0.01"


# ---- personal data ---------------------------------------------------------

def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        x = [int(c) for c in reversed(s)]
        return (sum(x[::2]) + sum(sum(divmod(2 * v, 10)) for v in x[1::2])) % 10 == 0

    spans = lambda pattern, keep: [m.span() for m in re.finditer(pattern, text) if keep(m.group())]
    return {
        "email": spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": spans(r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }


PIECES = ["a", "@", ".", "1", "25", "300", " ", "-", "+", "é", "(", ")", "b.c", "4532015112830366", "x@y.z", "0000"]


@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans(text):
    assert pii.detect(text) == brute_spans(text)
    base, found = pii.find_all(text)
    assert base == brute_spans(text)
    assert all(set(base[k]) <= set(found[k]) for k in pii.KINDS)


@pytest.mark.parametrize("disguised,kind", [
    ("john.doe [at] example [dot] com", "email"), ("john at example dot com", "email"), ("jane (at) mail.org", "email"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email"), ("u​ser@ex​ample.org", "email"), ("bob@example[.]com", "email"),
    ("plus four nine one five two three four five six seven eight", "phone"), ("+１ (234) 555-12 34", "phone"),
    ("four five three two zero one five one one two eight three zero three six six", "card"),
    ("１９２.168.1.7", "ip"), ("192[.]168[.]1[.]7", "ip"), ("192 dot 168 dot 1 dot 7", "ip"),
])
def test_disguises_map_back_to_the_source(disguised, kind):
    text = f"Écrire à: {disguised}, merci."
    base, found = pii.find_all(text)
    assert [text[a:b] for a, b in found[kind]] == [disguised]
    assert pii.mask(text) == f"Écrire à: [{kind}], merci."


@pytest.mark.parametrize("disguised,kind", [
    ("+1 four one five 555 0199", "phone"), ("+1 (four one five) five five five-0199", "phone"),
    ("one nine two dot one six eight dot one dot seven", "ip"), ("1 nine 2 point 168 point one point 7", "ip"),
    ("192 point 168 point 1 point 7", "ip"), ("one nine two [dot] one six eight [dot] one [dot] seven", "ip"),
    ("4532 zero one five one one two 83 zero three six six", "card"),
    ("jane at example dot ca", "email"), ("jane at mail dot example dot com dot au", "email"),
    ("jane dot doe at example.se", "email"), ("jane at a dot b dot c dot d dot e dot f dot travel", "email"),
])
def test_disguises_of_any_length(disguised, kind):
    text = f"Room one: {disguised}, thanks."
    found = pii.find_all(text)[1]
    assert [text[a:b] for a, b in found[kind]] == [disguised]
    assert pii.mask(text) == f"Room one: [{kind}], thanks."


@pytest.mark.parametrize("disguised,kind", [
    ("j\u043ehn@example.com", "email"), ("us\u200ber@example.org", "email"), ("john[dot]doe@example.com", "email"),
    ("john@mail.example dot com", "email"), ("+44 20 7946 09\uff158 23", "phone"),
])
def test_partly_disguised_data_is_found_whole(disguised, kind):
    text = f"Write to: {disguised}, thanks."
    base, found = pii.find_all(text)
    assert base[kind] and set(base[kind]) < set(found[kind])
    assert disguised in [text[a:b] for a, b in found[kind]]
    assert pii.mask(text) == f"Write to: [{kind}], thanks."


@pytest.mark.parametrize("text", ["look at example.com for the dot com boom", "one two three four five six seven eight",
                                  "meet at nine or at ten", "Он сказал: да.", "x " * 50,
                                  "look at the dot matrix printer", "We met at noon dot com boom",
                                  "arrive at gate dot then go", "at dot at dot at dot at", "a dot in time at dawn dot"])
def test_clean_text_is_left_alone(text):
    assert not any(pii.find_all(text)[1].values()) and pii.mask(text) == text


@pytest.mark.parametrize("address", [
    "a" * 70 + " at example dot com", "jane at " + "a dot " * 12 + "com", "j" * 100 + "@" + "h" * 80 + " dot org",
    "jane_9 at host dot " + "x" * 70 + " dot de"])
def test_addresses_of_any_size(address):
    assert pii.mask(f"mail {address}, thanks") == "mail [email], thanks"


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.sampled_from(["mail:", "a", "dot", "at", "com", "@", "x.y", "b9", "."]), max_size=14).map(" ".join))
def test_chained_signs_keep_the_source(text):
    traced = pii.spell_signs(pii.Traced(text))
    assert traced.spans is None or len(traced.spans) == len(traced.text)
    found = pii.find_all(text)[1]
    assert all(0 <= a < b <= len(text) for spans in found.values() for a, b in spans)


@pytest.mark.parametrize("part", ["a", "1", "+1", "a at ", " at a dot ", "a-_", "@ ", "1.", "@", "a@", "one ", " dot ", "1 ", "a dot ", "[at"])
def test_long_texts_take_linear_time(part):
    pii.find_all(part * (200_000 // len(part)) + "@b")


def test_documents_and_masking(spark):
    rows = awkward_rows() + [(500, "mail a@b.de or +1 (234) 555-1234", "en", "s", 32, "", "", 1)]
    found = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert found[500].spans == "email:5:11,phone:15:32" and (found[500].n_email, found[500].n_phone) == (1, 1)
    assert found[0].spans == "" and len(found) == len({r[0] for r in rows})
    masked = pii.mask_personal_data(frame(spark, rows))
    assert masked.schema == frame(spark, rows).schema and masked.count() == len(rows)
    hit = masked.filter("doc_id = 500").first()
    assert hit.text == "mail [email] or [phone]" and hit.n_chars == len(hit.text)
    assert masked.filter("doc_id = 0").first().text is None
    assert pii.find_personal_data(empty(spark)).count() == 0 and pii.mask_personal_data(empty(spark)).count() == 0


# ---- licenses --------------------------------------------------------------

def brute_license(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    places, labels = [], set()
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_license_places_and_notices(spark):
    notice = dict(licenses.NOTICES)["mit"]
    words = notice.split()
    texts = ["The MIT License, mit LICENSE; Apache-License", "GNU General Public License general public", "mit\nlicense",
             "mitlicense", notice, " ".join(words[:8] + ["indeed", "so"] + words[8:]).upper(), " ".join(words[:5]),
             " ".join(w for w in words for _ in "ab"), "license mit apache public general", "general public license " * 50]
    rows = awkward_rows() + [(1000 + i, t, "en", "s", 0, "", "", 0) for i, t in enumerate(texts)]
    rows.append((1000, texts[0], "en", "s", 0, "", "", 0))  # a repeated row
    out = licenses.scan_licenses(frame(spark, rows)).collect()
    base = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in out)
    want = sorted((str(r[0]), n, k, str(a), str(b), x) for r in rows for n, k, a, b, x in [brute_license(r[1])])
    assert base == want
    by_id = {r.doc_id: r for r in out}
    assert by_id[1004].labels == by_id[1005].labels == "mit" and by_id[1004].score == 1.0
    assert by_id[1006].labels == by_id[1007].labels == ""
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_words_behind_a_notice_do_not_hide_it(spark):
    notice, whole = dict(licenses.NOTICES)["apache"], dict(licenses.WHOLE_TEXTS)["isc"].split()
    texts = [notice + " the license" * 20, "the license " * 200 + notice + " the license" * 200,
             " ".join(w for i, w in enumerate(whole) if i % 9), "the license " * 500,
             " ".join(whole[:30]), " ".join(x for w in whole for x in (w, "put", "in"))]
    rows = [(i, t, "en", "s", 0, "", "", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert [got[i].labels for i in range(6)] == ["apache", "apache", "isc", "", "", ""]
    assert got[0].score == got[1].score == 1.0


# ---- quality classifier ----------------------------------------------------

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    scores, first, moves = rng.normal(size=11) * 2, np.array([0, 3, 3, 8, 9, 11]), rng.normal(size=(2, 2))
    good, log_z, expected = quality_crf.marginals(scores, first, moves, pairs=True)
    want, want_z, want_pairs = np.zeros(11), 0.0, np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        total, of_line, of_pair = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=b - a) if b > a else ():
            w = np.exp(sum(scores[a + i] * s for i, s in enumerate(states))
                       + sum(moves[x, y] for x, y in zip(states, states[1:])))
            total += w
            of_line += w * np.array(states)
            for x, y in zip(states, states[1:]):
                of_pair[x, y] += w
        if b > a:
            want[a:b], want_z, want_pairs = of_line / total, want_z + np.log(total), want_pairs + of_pair / total
    assert np.allclose(good, want) and np.isclose(log_z, want_z) and np.allclose(expected, want_pairs)


def test_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_crf.fit(docs, labels)
    scored = quality_crf.score_documents(docs, model).join(labels, "doc_id").toPandas()
    held = scored[scored.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert ((scored.score >= 0.7) == (scored.predicted == 1)).all()
    # Labels of held-out rows and columns other than the text change nothing.
    turned = labels.withColumn("quality", F.when(quality_crf.is_held_out(F.col("doc_id")), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    other = quality_crf.fit(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), turned)
    assert np.allclose(other.weights, model.weights)
    rows = awkward_rows()
    out = quality_crf.score_documents(frame(spark, rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id in (0, 1, 2)} == {model.prior}
    assert quality_crf.score_documents(empty(spark), model).count() == 0
    none = quality_crf.fit(docs, labels.filter("false"))
    assert quality_crf.score_documents(docs.limit(5), none).count() == 5


def test_training_takes_whole_documents(spark, monkeypatch):
    good, bad = "A plain line of words, number %d.", "### %d $$$ {{ ||| }} ###"
    docs, labels = [], []
    for i in range(12):
        body = [good % k for k in range(230)] + [bad % k for k in range(170)] * (i % 2)
        docs.append((i, "\n".join(body)))
        labels.append((i, 1 - i % 2))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    seen, train = [], quality_crf.train
    monkeypatch.setattr(quality_crf, "train", lambda x, first, y, **k: seen.append((np.diff(first), y)) or
                        train(x, first, y, rounds=20))
    model = quality_crf.fit(docs, labels)
    lines, y = seen[0]
    assert len(lines) and (lines == np.where(y == 1, 230, 400)).all()
    score = quality_crf.score_texts(pa.array([good % 1, bad % 1]), model)
    assert score[0] > score[1]
    # A bound on all lines takes fewer documents, each of them whole.
    quality_crf.fit(docs, labels, most_lines=900)
    fewer, y = seen[1]
    assert 0 < len(fewer) < len(lines) and (fewer == np.where(y == 1, 230, 400)).all() and fewer.sum() <= 900
    quality_crf.fit(docs, labels, most_lines=300)
    assert set(seen[2][0]) == {230}


def test_features_do_not_depend_on_neighbouring_texts():
    texts = ["One line here.\nAnother line there!\n\n  \nlast", "", "alone", "a\na\na\nb"]
    def features(column):
        out = []
        for _, _, data, cut in quality_crf.text_slices(pa.array(column, pa.string())):
            x, _, first = quality_crf.line_features(data, cut)
            out += [x[a:b] for a, b in zip(first[:-1], first[1:])]
        return out
    together = features(texts)
    assert [len(x) for x in together] == [3, 0, 1, 4]
    for text, mine in zip(texts, together):
        assert np.allclose(features([text])[0], mine)


# ---- language --------------------------------------------------------------

def test_languages(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    unlabelled = docs.withColumn("lang", F.when(~held, F.col("lang")))
    out = langid.identify(unlabelled, pages).toPandas()
    assert len(out) == docs.count() + pages.count()
    truth = {r.doc_id: r.lang for r in docs.filter(held).select("doc_id", "lang").collect()}
    mine = out[out.doc_id.isin(truth.keys())]
    assert (mine.lang == mine.doc_id.map(truth)).mean() > 0.98
    assert out.probability.between(0.2, 1.0000001).all()
    on_pages = out[out.kind == "page"]
    assert (on_pages.lang == on_pages.declared).mean() > 0.95


def test_evidence_decides_where_text_does_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    html = "<html{}><body><script>var x='<p>'</script><!-- a --> ok </body></html>"
    pages = spark.createDataFrame(
        [(1, "https://a.example.fr/x", html.format(' lang="fr-FR"')), (2, None, html.format("")), (3, "nonsense", None),
         (4, "http://b.example.de", "<html")], "page_id long, url string, html string")
    out = {r.page_id: r for r in langid.identify(docs, pages).filter("kind = 'page'").collect()}
    assert out[1].lang == "fr" and out[1].declared == "fr" and out[1].suffix == "fr"
    assert out[2].host is None and out[3].host is None and out[4].host == "b.example.de"
    assert langid.visible_text(html.format("")).split() == ["ok"]


@pytest.mark.parametrize("html,words", [
    ("<p>price < 5 or more</p> end", "price < 5 or more end"), ("a <3 b", "a <3 b"), ("x<y and <b", "x <y and <b"),
    ("<!DOCTYPE html><?xml?><b>one</b> 1 < 2", "one 1 < 2"), ("one <script>a < b", "one"),
])
def test_a_stray_sign_opens_no_tag(html, words):
    assert langid.visible_text(html).split() == words.split()


def test_languages_of_awkward_tables(spark):
    out = langid.identify(frame(spark, awkward_rows())).collect()
    assert len(out) == len(awkward_rows()) and all(r.lang in ("en", "fr") for r in out)
    assert langid.identify(empty(spark)).count() == 0
    unlabelled = langid.identify(frame(spark, awkward_rows()).withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang, r.probability) for r in unlabelled.collect()} == {(None, 0.0)}


def brute_fusion(model, records):
    """(lang, probability) per record (kind, text, host, domain, suffix, declared), one by one from all the others."""
    langs, n = model.languages, len(model.languages)
    scores = model.scores(pa.array([r[1] for r in records], pa.string()))
    posterior = np.exp(scores - scores.max(1, keepdims=True))
    posterior /= posterior.sum(1, keepdims=True)
    world = (posterior.sum(0) + 1) / (len(records) + n)
    declared = [langs.index(r[5]) if r[5] in langs else None for r in records]
    sure = [posterior[i, d] for i, d in enumerate(declared) if d is not None and scores[i].max() != 0]
    agreement = (sum(sure) + 1) / (len(sure) + 2)

    def shares(i, alike, above, rows=posterior):
        others = [j for j in range(len(records)) if j != i and alike(records[j]) and rows[j] is not None]
        return (sum((rows[j] for j in others), np.zeros(n)) + langid.PULL * above) / (len(others) + langid.PULL)

    out = []
    for i, (kind, _, host, domain, suffix, code) in enumerate(records):
        above = shares(i, lambda r: r[0] == kind and r[3] == domain, world) if domain else world
        above = shares(i, lambda r: r[0] == kind and r[2] == host, above) if host else above
        total = scores[i] + np.log(above)
        if suffix:
            said = [None if d is None else np.eye(n)[d] for d in declared]
            total += np.log(shares(i, lambda r: r[4] == suffix, shares(i, lambda r: r[4] == suffix, world, said)) / world)
        if declared[i] is not None:
            prior = (1 - agreement) * world / (1 - world[declared[i]])
            prior[declared[i]] = agreement
            total += np.log(shares(i, lambda r: r[5] == code, prior) / world)
        total = np.exp(total - total.max())
        out.append((langs[int(total.argmax())], total.max() / total.sum()))
    return out


def test_fusion_record_by_record(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150").withColumn("extra", F.lit(1))
    some = docs.filter("text IS NOT NULL").orderBy("doc_id").limit(40).collect()
    rows = [(k, f"https://{'www' if k % 2 else 'm'}.site{k % 3}.{('fr', 'de', 'com')[k % 3]}/p",
             f"<html{' lang=' + (r.lang or 'xx') if k % 4 else ''}><p>{r.text[: 40 * (k % 5)]}</p>") for k, r in enumerate(some)]
    rows += [(100, None, None), (101, "http://one.xyz", "<html lang='zz-top'>"), (102, "http://two.fr", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = langid.train(docs)
    records = [("document", r.text, r.source, r.source, None, langid.language_code(r.lang)) for r in docs.collect()]
    for _, url, html in rows:
        host, found = langid.host_of(url), langid._HTML_LANG.search(html or "")
        records.append(("page", langid.visible_text(html or ""), host, ".".join(host.split(".")[-2:]) if host else None,
                        host.rsplit(".", 1)[1] if host else None, langid.language_code(found.group(1)) if found else None))
    want = sorted((r[0], lang, round(x, 6)) for r, (lang, x) in zip(records, brute_fusion(model, records)))
    got = sorted((r.kind, r.lang, round(r.probability, 6)) for r in langid.identify(docs, pages).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)


def test_short_texts_of_a_language_in_one_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["", "ab", None, "some text"], pa.string()),
                                        pa.array(["de", "fr", "it", "en"], pa.string())], names=["text", "lang"])
    out = list(langid._count(iter([batch])))
    assert {b.schema for b in out} == {out[0].schema} and out[0].schema.field("lang").type == pa.string()
    assert {c for b in out for c in b.column("lang").to_pylist()} == {"en"}


def test_languages_are_bounded(spark):
    rows = [(k, "text of some length " * (1 + k % 7), f"{'abcdefg'[k % 7]}{'xyz'[k % 3]}") for k in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=5)
    assert len(model.languages) == 5 and all(code[0] in "efg" for code in model.languages)


def test_batches_are_worked_on_in_slices():
    import pyarrow as pa

    from trendlens.llm.common import batch_slices
    texts = ["x" * 900, None, "", "é" * 700, "y" * 5000, "z", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(batch_slices(batch, 1, 1000))
    assert pa.Table.from_batches(parts).combine_chunks().to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 1000 for p in parts)
    assert len(parts) > 3
    assert [p.to_pylist() for p in batch_slices(batch.slice(3, 2), 1, 1000)] == [[r] for r in batch.slice(3, 2).to_pylist()]
