"""The operators of the llm subpackage: SQL or brute force beside each query, and the odd inputs."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zlib

import corpus_pipeline
from checks.verify import compare, duck
from pyspark.sql import functions as F
from recspark.llm import ann, chat, decontaminate, hmm, langid, mixing, pii, quality, simhash, warc
from recspark.llm.common import permuted, table
from recspark.llm.components import components
from recspark.llm.oracle import ORACLES
from recspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, number int, __x string, words string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns with names that operators use inside."""
    long = " ".join(f"w{i % 700}" for i in range(20_000))
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, "en", None),
            (3, "", None, "b"), (None, "one two three four five six", "fr", "a"), (4, long, "en", None), (5, "  \t\n ", "fr", "b"),
            (None, None, None, None), (6, "12 34 !!", "en", "c"), (7, "ein zwei drei vier fünf ÄÖÜ", "de", "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF).toArrow(), duck(SF).sql(ORACLES[name]).to_arrow_table()) == ""


# 1. Mixing


def test_permutation_and_its_inverse():
    for size in (1, 2, 3, 17, 1000):
        out = permuted(np.arange(size), size, 5)
        assert sorted(out) == list(range(size)) and (permuted(out, size, 5, True) == np.arange(size)).all()


def test_targets_stop_at_three_times_the_size():
    got = mixing.targets([1, 100, 1000, 0], [3, 1, 1, 2], 3)
    assert got[0] == 3 and got[3] == 0 and sum(got) == pytest.approx(1101) and got[1] == 300


def test_mix_reaches_targets_and_repeats(spark, odd, none):
    mixture = mixing.mix(odd, block_words=16, shard_slots=32)
    rows = mixing.taken(mixture).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += r["taken"]
    assert {s.name: round(s.target) for s in mixture.sources} == dict(by)
    again = mixing.taken(mixing.mix(odd, block_words=16, shard_slots=32)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    texts = mixing.texts(mixture, odd).collect()
    assert sum(len(r["text"].split()) for r in texts) == sum(by.values()) == sum(r["n_words"] for r in texts)
    assert mixing.taken(mixing.mix(none)).count() == 0


# 2. WARC


def test_archive_round_trip_with_small_splits(spark):
    body = "é" * 60
    rows = [(1, "http://a/ b\n", body), (2, None, body), (3, "u", None), (4, "u", "x"), (5, "u", "x"), (None, "n", body), (6, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, digest int")
    found = warc.archive(pages, split_bytes=97).select(warc.page_of("record_id").alias("id"), "record_type", warc.page_of("refers_to").alias("to"), "payload", "payload_length")
    got = {r["id"]: r for r in found.collect()}
    assert found.count() == 7 and len(got) == 7
    assert [got[i]["record_type"] for i in (1, 2, 3, 4, 5, None, 6)] == ["response", "revisit", "response", "response", "response", "revisit", "response"]
    assert got[2]["to"] == 1 and got[2]["payload_length"] == 120 and bytes(got[6]["payload"]) == b"y" * 300_000 and bytes(got[3]["payload"]) == b""
    assert warc.archive(pages.limit(0)).count() == 0


# 3. Language


def test_languages_of_held_out_documents(spark, odd, none):
    rows = {r["doc_id"]: r for r in QUERIES["op3_langid"](spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    held = [i for i in rows if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    model = langid.fit(table(spark, SF, "documents"))
    got = langid.predict(odd, model, [F.col("doc_id"), F.col("words")]).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 5, 6)} == {"und"}
    assert langid.fit(none) is None and {r["lang_pred"] for r in langid.predict(odd, None, [F.col("doc_id")]).collect()} == {"und"}


def test_prediction_equals_a_plain_nearest_centroid(spark):
    docs = table(spark, SF, "documents").filter("doc_id < 80")
    model = langid.fit(docs)
    for r in langid.predict(docs, model, [F.col("text")]).collect():
        data = b" " + b" ".join((r["text"] or "").lower().encode().translate(langid.LETTERS).split()) + b" "
        grams = Counter()
        for n in (1, 2, 3):
            for i in range(len(data) - n + 1):
                code = int.from_bytes(data[i : i + n], "big") + (0 if n == 1 else 1 << 24)
                code = code if n < 3 else (int.from_bytes(data[i : i + 2], "big") + (1 << 24)) << 8 | data[i + 2]
                grams[(code * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        vector = {g: np.log1p(c) * model.idf[g] for g, c in grams.items()}
        length = np.sqrt(sum(v * v for v in vector.values())) or 1.0
        cosine = [sum(v / length * centre[g] for g, v in vector.items()) for centre in model.centroids]
        best = int(np.argmax(cosine))
        if re.search(r"[^\W\d_]", r["text"] or ""):
            assert r["score"] == pytest.approx(cosine[best], abs=1e-4)
            assert r["lang_pred"] == model.languages[best] or sorted(cosine)[-1] - sorted(cosine)[-2] < 1e-4
            assert r["rejected"] == (cosine[best] < model.least[best]) or abs(cosine[best] - model.least[best]) < 1e-4


# 4. PII


def test_surrogates_keep_kind_layout_and_coreference(spark, odd, none):
    text = (
        "Mrs. Anna Smith wrote to Mr. Jones: +1 (017) 555-7713, +1 017 555 7713; card 4111 1111 1111 1111 = 4111-1111-1111-1111, "
        "JOE.x@mail4.example.com joe.x@mail4.example.com 10.1.2.3 8.8.4.4 " + "0a" * 20 + " Г-жа Петрова DE89 3704 0044 0532 0130 00 123-45-6789"
    )
    docs = spark.createDataFrame([(1, text, "k"), (2, "nothing here", "k"), (3, "call +1 017 555 7713", "k"), (3, "call +1 017 555 7713", "k")], "doc_id long, text string, kind string")
    rows = pii.pseudonymise(docs, "key").collect()
    out = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == 4 and out[2] == "nothing here" and rows[0].asDict().keys() == {"doc_id", "text", "kind"}
    for old in ("Anna", "Smith", "Jones", "7713", "4111", "JOE", "joe.x", "10.1.2.3", "8.8.4.4", "0a" * 20, "Петрова", "3704", "6789"):
        assert old not in out[1]
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}), \+1 (\d{3}) (\d{3}) (\d{4})", out[1])[0]
    assert phones[:3] == phones[3:] and out[3].endswith(" ".join(phones[:3]))
    a, b = re.findall(r"card ([\d ]+) = ([\d-]+),", out[1])[0]
    digits = a.replace(" ", "")
    assert digits == b.replace("-", "") and digits[0] == "4"
    assert sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"Mrs\. \w+ \w+ wrote to Mr\. \w+:", out[1]) and re.search(r"Г-жа [А-Я][а-я]+ова", out[1])
    upper, lower = re.findall(r"(\S+)@\S+ (\S+)@", out[1])[0]
    assert upper.lower() == lower and upper != lower and " 10." in out[1]
    assert pii.pseudonymise(odd, "key").count() == odd.count() and pii.pseudonymise(none, "key").count() == 0


def test_names_are_replaced_by_their_parts(spark):
    text = (
        "Mrs. Anna Smith called. Anna Smith said hi. Mrs. Smith left, SMITH too. Dr. Bob Jones, 2001:db8::1, ::1, Prof. Dr. Eva Braun. Mr. O'Neil. "
        "Mr. Jean-Luc Picard. Ms. ANNA SMITH. std::vector a::b. Herr Müller-Weiß und Müller-Weiß; Г-жа Анна Петрова, Петрова. Smithson Annabel"
    )
    docs = spark.createDataFrame([("a", text), ("b", "Dr. Anna Smith and Eva Braun"), ("c", None), ("d", "")], "doc_id string, text string")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "key").collect()}
    found = re.match(
        r"Mrs\. (\w+) (\w+) called\. (\w+) (\w+) said hi\. Mrs\. (\w+) left, (\w+) too\. Dr\. (\w+) (\w+), ([0-9a-f:]+), ([0-9a-f:]+), Prof\. Dr\. (\w+) (\w+)\. "
        r"Mr\. (\w+)\. Mr\. (\w+) (\w+)\. Ms\. (\w+) (\w+)\. std::vector a::b\. Herr (\w+) und (\w+); Г-жа (\w+) (\w+), (\w+)\. Smithson Annabel$", out["a"],
    )
    assert found, out["a"]
    g = found.groups()
    assert g[0] == g[2] and g[1] == g[3] == g[4] and g[5] == g[16] == g[1].upper() and g[15] == g[0].upper()
    assert g[17] == g[18] and g[20] == g[21] and g[20].endswith("ова") and g[8] != "2001:db8::1" and g[0] in pii.GIVEN["latin_f"]
    for old in ("Anna ", "Smith ", "Bob", "Jones", "Eva", "Braun", "Neil", "Jean", "Picard", "ANNA", "SMITH", "Müller", "Анна", "Петрова", "2001:db8::1"):
        assert old not in out["a"]
    # Another document: the same parts behind another title; a name that no title introduces there stays.
    assert out["b"] == f"Dr. {g[0]} {g[1]} and Eva Braun" and out["c"] is None and out["d"] == ""
    counted = {r["doc_id"]: r["n"] for r in pii.pseudonymise(docs, "key", count="n").collect()}
    assert counted["b"] == 1 and counted["c"] == counted["d"] == 0 and counted["a"] > 12


def test_no_text_needs_a_deep_stack(spark):
    dotted = "a." * 200_000 + "a"
    texts = [dotted, dotted + "@", dotted + "@" + dotted, "a@" + "b." * 200_000 + "c", "f" * 300_000, "4111 " * 50_000, "+1 " + "23 " * 100_000, "DE89 " * 60_000,
             "1:" * 150_000, "1.2.3." * 50_000, "Mr. " * 80_000, "Mr. " + "A-b'" * 80_000, "Mr. X" + "y" * 300_000, "'-" * 100_000, "Mr. " + "Ab " * 80_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.pseudonymise(docs, "key").count() == len(texts)


def test_names_of_columns_do_not_clash(spark):
    names = ["__id", "__hash", "__map", "__nth", "__lang", "__n", "row", "_row", "names", "map", "mention", "word", "replacement", "size", "hash", "id", "component", "node"]
    rows = [(i, f"call +1 017 555 77{i:02} Mr. Smith said, the river ran over the old bridge near the mill number {i % 3}") for i in range(6)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for got in (pii.pseudonymise(docs, "k"), quality.keep_good(docs, labels), simhash.keep_one(docs),
                decontaminate.drop_contaminated(docs, spark.createDataFrame([("x", "none of it")], "item_id string, text string"))):
        assert got.columns == docs.columns and 0 < got.count() <= 6


def test_surrogates_stay_distinct_in_a_crowded_space(spark):
    rows = spark.range(600).select(F.lit("ssn").alias("kind"), F.lpad((F.col("id") * 7).cast("string"), 3, "0").alias("canonical"))
    got = pii.surrogates(rows.filter("length(canonical) = 3"), "k").collect()
    assert len({r["surrogate"] for r in got}) == len(got) and not {r["surrogate"] for r in got} & {r["canonical"] for r in got}


# 5. Decontamination


def test_windows_of_all_lengths(spark, odd, none):
    items = spark.createDataFrame([(1, "Three FOUR"), (2, "five"), (3, None), (4, ""), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (5, "five"), (None, "six")], "item_id long, text string")
    rows = decontaminate.contamination(odd, items).collect()
    first = [r for r in rows if r["doc_id"] == 1]
    assert len(rows) == odd.count() and len(first) == 2 and {(r["n_words"], r["n_hit"], tuple(r["items"])) for r in first} == {(6, 4, ("", "1", "2", "5"))}
    long = next(r for r in rows if r["doc_id"] == 4)
    assert long["n_hit"] == 11 * sum(1 for i in range(20_000) if i % 700 == 5 and i + 11 <= 20_000)
    assert decontaminate.drop_contaminated(odd, items).count() == odd.count() - 4
    assert decontaminate.contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(none, items).count() == 0


def test_many_marks_and_string_ids(spark):
    rng = np.random.default_rng(4)
    items = [(f"i{i}", " ".join(f"t{w}" for w in rng.integers(0, 300, 14))) for i in range(200)]
    docs = []
    for i in range(60):
        words = [f"t{w}" for w in rng.integers(0, 300, 80)]
        if i % 3 == 0:
            at = int(rng.integers(0, 60))
            words[at : at + 11] = items[i][1].split()[:11]
        docs.append((f"d{i}", " ".join(words)))
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    ).collect()
    grams = {" ".join(t.split()[i : i + 10]): n for n, t in items for i in range(5)}
    for r in found:
        words = dict(docs)[r["doc_id"]].split()
        starts = [i for i in range(71) if " ".join(words[i : i + 10]) in grams]
        assert r["n_hit"] == len({p for i in starts for p in range(i, i + 10)})
        assert r["items"] == sorted({grams[" ".join(words[i : i + 10])] for i in starts})
    assert sum(r["n_hit"] > 0 for r in found) == 20
    marks = decontaminate.marks_of(spark.createDataFrame([(5,), (-1,), (2**40,)], "token long"))
    assert len(marks) == 1024 and [i for i, m in enumerate(marks) if m] == [0, 5, 1023]


# 6. Chat


def test_chat_of_odd_turns(spark):
    rows = [(1, 0, "a", "hi"), (1, 0, "a", "hi"), (1, None, None, None), (2, 0, "system", "s"), (None, 3, "b", "x")]
    got = chat.perspectives(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int"), 2).collect()
    assert sorted((str(r["conv_id"]), r["speaker"], r["part"], r["n_turns"]) for r in got) == [
        ("1", "a", 0, 2), ("1", "a", 1, 1), ("1", "unknown", 0, 2), ("1", "unknown", 1, 1), ("None", "b", 0, 1)]
    for r in got:
        assert all(r["text"][s["start"] : s["stop"]].endswith("<|end|>\n") for s in r["spans"])


def test_parts_of_long_and_sparse_conversations(spark):
    rows = [(1, 5000 * i, "ab"[i % 2], f"t{i}") for i in range(6)] + [(2, i, "c", "x" * (i % 3)) for i in range(2500)] + [(3, 7, "d", "same")] * 50
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.perspectives(talks).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {(1, "a", 0): 6, (1, "b", 0): 6, (2, "c", 0): 1024, (2, "c", 1): 1024, (2, "c", 2): 452, (3, "d", 0): 50}
    assert [m[0] for m in re.findall(r"(t\d)<", got[1, "a", 0]["text"])] == ["t"] * 6 and re.findall(r"t(\d)<", got[1, "a", 0]["text"]) == list("012345")
    said = "".join(got[2, "c", p]["text"] for p in range(3))
    assert said == "".join(f"<|assistant|>\n{'x' * (i % 3)}<|end|>\n" for i in range(2500))
    assert chat.perspectives(talks.limit(0)).count() == 0


# 7. Quality


def test_trigram_probabilities_sum_to_one_and_junk_goes(spark, odd, none):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert np.allclose((2.0 ** -quality.fit(docs).astype(np.float64)).sum(axis=2), 1, atol=1e-4)
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    seen = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    assert np.mean([i in kept for i, s in seen.items() if s == (1, 0)]) > 0.97
    assert np.mean([i in kept for i, s in seen.items() if s[0] == 0]) < 0.3
    assert quality.judge(odd, labels).count() == odd.count() and quality.keep_good(none, labels).count() == 0
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()


def test_documents_meet_the_counts_by_joins(spark, monkeypatch):
    """Texts of several shards, with trigrams, contexts and symbols that the model has not seen, get the bits of the whole model."""
    monkeypatch.setattr(quality, "SHARD_BYTES", 64)
    texts = ["the cat sat on the mat", "the dog sat", "zebra! é 漢", "", None, "the cat sat on the mat"] * 20
    docs = spark.createDataFrame([(i % 117, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = docs.filter("doc_id < 2")
    model, whole = quality.train(trusted), quality.fit(trusted).ravel()
    scored = quality.score(docs, model)
    assert "SortMergeJoin" in scored._jdf.queryExecution().executedPlan().toString()
    want = sorted((i % 117, len(t or "") + 1, float(whole[quality.trigrams(t)].sum(dtype=np.float64))) for i, t in enumerate(texts))
    assert sorted((r["doc_id"], r["n_symbols"], r["bits"]) for r in scored.collect()) == want
    nothing = quality.train(trusted.limit(0))
    assert {r["bits"] for r in quality.score(docs.filter("text = ''"), nothing).collect()} == {float(quality.BITS)}


# 8. SimHash


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values, linked):
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if linked(i, j):
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_simhash_equals_brute_force(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    prints = [plain_fingerprint(t, 4) for _, t in docs]
    want = roots(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = QUERIES["op8_simhash"](spark, SF).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got] == [(docs[i][0], f"{p:016x}", docs[w][0]) for i, (p, w) in enumerate(zip(prints, want))]
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 2, 4, 6, 7] and len(kept) == 5


def test_bit_sliced_forest_equals_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    values = base[rng.integers(0, 4, 300)]
    for k in range(300):
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            values[k] ^= np.uint64(1) << np.uint64(b)
    sizes = np.array([200, 70, 30])
    bucket = np.repeat(range(3), sizes)
    want = roots(values, lambda i, j: bucket[i] == bucket[j] and int(values[i] ^ values[j]).bit_count() <= 4)
    assert want == list(simhash.forest(values, sizes, 4))


def test_large_buckets_meet_in_blocks(spark):
    rng = np.random.default_rng(5)
    values = [int(v) for v in rng.integers(0, 1 << 12, 300)]
    prints = spark.createDataFrame([(v,) for v in set(values)], "fingerprint long")
    own = sorted(set(values))
    links = simhash.links(prints, most=40)
    found = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    want = roots(own, lambda i, j: (own[i] ^ own[j]).bit_count() <= 4)
    assert [found.get(v, v) for v in own] == [own[w] for w in want]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


# 9. Neighbours


def test_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 16)))]
    odd = [(None, rows[0][1]), (5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (40, rows[40][1]), (5005, rows[20][1])]
    vectors = ann.usable(spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, block int"))
    got = ann.search(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    assert not {r["vec_id"] for r in got} & {5000, 5001, 5002, 5003}
    matrix, ids = np.array([r[1] for r in rows] + [rows[20][1]]), np.array([r[0] for r in rows] + [5005])
    hits, total = 0, 0
    found = defaultdict(list)
    for r in got:
        assert r["vec_id"] != r["query_id"]
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 3000, 20):
        score = matrix @ matrix[q]
        score[ids == q] = -np.inf
        best = [int(i) for i in ids[np.lexsort((ids, -score))[:20]]]
        hits, total = hits + len(set(best) & {v for _, v, _ in found[q]}), total + 20
        assert [r for r, _, _ in sorted(found[q])] == list(range(1, 21))
    assert hits / total >= 0.9
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0


# 10. Hidden Markov model


def test_recursions_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    states, symbols = 3, 6
    model = hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T)
    texts = [rng.integers(0, symbols, n) for n in (5, 1, 3, 3, 6)]
    start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)), 0.0
    for x in texts:
        paths = list(itertools.product(range(states), repeat=len(x)))
        chance = np.array([model.start[p[0]] * model.emit[x[0], p[0]] * np.prod([model.move[p[t - 1], p[t]] * model.emit[x[t], p[t]] for t in range(1, len(x))]) for p in paths])
        total += np.log(chance.sum())
        for p, c in zip(paths, chance / chance.sum()):
            start[p[0]] += c
            for t, s in enumerate(p):
                emit[x[t], s] += c
                if t:
                    move[p[t - 1], s] += c
    for cells in (1, 7, 13, 1000):  # how many forward values are kept at a time
        got = hmm.expected(texts, model, cells)
        assert all(np.allclose(a, b) for a, b in zip(got, (start, move, emit, total)))


def test_base_score_counts_and_odd_texts(spark, odd, none):
    rows = {r["doc_id"]: r for r in QUERIES["op10_hmm"](spark, SF).collect()}
    docs = {r["doc_id"]: hmm.words(r["text"]) + [None] for r in table(spark, SF, "documents").collect()}
    counts = Counter()
    for i, words in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words)
    total = sum(counts.values())
    for i, words in docs.items():
        assert rows[i]["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words))
        assert rows[i]["n_known"] == sum(counts[w] > 0 for w in words) and rows[i]["train_tokens"] == total
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # Few frequent words, so that most counts come through the join.
    few = {r["doc_id"]: r for r in hmm.score(table(spark, SF, "documents"), F.expr("crc32(cast(doc_id as string)) % 7 <> 2"), own=5, lookup=50).collect()}
    assert all(few[i]["base_score"] == pytest.approx(rows[i]["base_score"]) and few[i]["n_known"] == rows[i]["n_known"] for i in rows)
    every, no = F.lit(True), F.lit(False)
    assert hmm.score(odd, every).count() == odd.count() and hmm.score(none, every).count() == 0 and hmm.score(odd, no).count() == odd.count()
    assert hmm.score(odd, F.lit(None).cast("boolean")).count() == odd.count()
    named = hmm.score(odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), every)
    assert {r["doc_id"] for r in named.collect()} == {None, "d1", "d2", "d3", "d4", "d5", "d6", "d7"}


def test_scores_equal_a_plain_forward_recursion(spark):
    """Every number of `score` from the counts, the classes and the trained model, one text and one step at a time."""
    docs = table(spark, SF, "documents").filter("doc_id < 60").withColumn("learns", F.lit(True))
    options = {"states": 3, "rounds": 2, "own": 20, "lookup": 40, "classes": 8, "pseudo": 1.0}
    got = {r["doc_id"]: r for r in hmm.score(docs, F.col("learns"), **options).collect()}
    counts = Counter(w for r in docs.collect() for w in hmm.words(r["text"]))
    counted = hmm.count_words(docs, 8)
    v = hmm.vocabulary(counted, docs.count(), 20, 40, 8)
    model = hmm.train(hmm.encoded(docs, v), v, 3, 2, 1.0)
    own = {w: i for w, i in v.index.items() if i < v.own}
    classes = defaultdict(list)
    for w in counts:
        if w not in own:
            classes[hmm.ending(w, 8)].append(w)
    for r in docs.collect():
        total, alpha = 0.0, None
        for w in [*hmm.words(r["text"]), None]:
            symbol, inside = own.get(w), 1.0
            if w is None:
                symbol = v.end
            elif symbol is None:
                kind = hmm.ending(w, 8)
                symbol = v.own + kind
                inside = (counts[w] + 1) / (sum(counts[o] for o in classes[kind]) + len(classes[kind]) + 1)
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[symbol] * inside
            total += np.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert got[r["doc_id"]]["score"] == pytest.approx(total, rel=1e-6)


def test_last_model_holds_counts_of_all_training_documents(spark):
    docs = spark.createDataFrame([(i, f"some words and u{i}") for i in range(40)], "doc_id long, text string")
    counted = hmm.count_words(docs, 16)
    v = hmm.vocabulary(counted, 40, 100, 1000, 16)
    coded = hmm.encoded(docs.withColumn("learns", F.lit(True)), v)
    model = hmm.train(coded, v, 2, 4, 1e-9)
    assert model.emit[: v.own].sum(axis=1).min() > 1e-4
    # The first guess adds up all documents as well.
    assert hmm._guess(coded, v, 2).sum() == 5 * 40


# Pipeline


def document_rows(spark, texts, lang="en"):
    rows = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_quality_stage_equals_a_plain_model(spark):
    """Kneser-Ney over dictionaries, quantiles over sorted lists, and the rule that rejects."""
    docs = table(spark, SF, "documents").filter("doc_id < 120")
    labels = table(spark, SF, "labels")
    rows = docs.collect()
    said = defaultdict(list)
    for r in labels.collect():
        said[r["doc_id"]].append(r["quality"] == 1 and not r["toxic"])
    trusted = [r for r in rows if said.get(r["doc_id"]) and all(said[r["doc_id"]])]

    def grams(text):
        edge = quality.EDGE
        x = [edge, edge, *(int(quality.ALPHABET[ord(c)]) for c in text or ""), edge]
        return list(zip(x, x[1:], x[2:]))

    def discounted(counts):
        n = [max(sum(c == k for c in counts.values()), 1) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        cuts = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3)]
        total, cut = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            cut[g[:-1]] += cuts[min(c, 3) - 1]
        return {g: (c - cuts[min(c, 3) - 1]) / total[g[:-1]] for g, c in counts.items()}, {h: cut[h] / total[h] for h in total}

    three = Counter(g for r in trusted for g in grams(r["text"]))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)
    (s3, r3), (s2, r2), (s1, r1) = discounted(three), discounted(two), discounted(one)

    def bits(g):
        p = s1.get(g[2:], 0) + r1[()] / quality.SYMBOLS
        p = s2.get(g[1:], 0) + r2.get(g[1:2], 1) * p
        return -np.log2(s3.get(g, 0) + r3.get(g[:2], 1) * p)

    measured = {r["doc_id"]: (r["lang"], len(grams(r["text"])), sum(map(bits, grams(r["text"])))) for r in rows}

    def quantile(values, share):
        bins = sorted(int(np.ceil(v * quality.BINS)) for v in values)
        return next(b for i, b in enumerate(bins, 1) if i >= share * len(bins)) / quality.BINS

    good = [measured[r["doc_id"]] for r in trusted]
    languages = {g[0] for g in good}
    middle = {lang: quantile([t / n for g, n, t in good if g == lang], 0.5) for lang in languages}
    middle[None] = quantile([t / n for _, n, t in good], 0.5)

    def entropy(m):
        return (m[2] + 100 * middle.get(m[0], middle[None])) / (m[1] + 100)

    def threshold(lang):
        mine = [entropy(g) for g in good if g[0] == lang or lang not in languages]
        return quantile(mine, 0.5) + 5 * (quantile(mine, 0.9) - quantile(mine, 0.5))

    want = {i for i, m in measured.items() if entropy(m) <= threshold(m[0])}
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    for i, m in measured.items():
        assert got[i]["perplexity"] == pytest.approx(2 ** (m[2] / m[1]), rel=1e-4)
        assert got[i]["threshold"] == pytest.approx(threshold(m[0]), abs=2e-3)
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == want and 60 < len(want) < 120


def test_near_duplicate_stage_equals_brute_force(spark, odd, none):
    rng = np.random.default_rng(11)
    texts = []
    for g in range(12):
        base = [f"w{g}x{k}" for k in rng.integers(0, 5000, 400 + 60 * g)]
        for edits in (0, 0, 1, 2, 4, 40):
            words = list(base)
            for at in rng.choice(len(words), edits, replace=False):
                words[at] = f"new{rng.integers(1 << 40)}"
            texts.append(" ".join(words))
    docs = document_rows(spark, [*texts, "", None, "  "])
    prints = [plain_fingerprint(r["text"], 4) for r in docs.orderBy("doc_id").collect()]
    up = roots(prints, lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4)
    kept = corpus_pipeline.one_of_each(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(up)) and 12 < len(set(up)) < 60 and kept.columns == docs.columns
    # Rows without an id and equal rows as well: one of each group.
    assert corpus_pipeline.one_of_each(spark, odd, SF).groupBy(F.xxhash64("text")).count().filter("count > 1").isEmpty()
    assert corpus_pipeline.one_of_each(spark, none, SF).count() == 0


def test_decontamination_stage_equals_brute_force(spark):
    items = [re.findall(decontaminate.WORD, r["text"].lower()) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    texts = [r["text"] for r in table(spark, SF, "documents").collect()]
    texts += ["before " + " ".join(w[:12]).upper() + " after" for w in items[:20] if len(w) >= 10] + ["x " + " ".join(w[:9]) for w in items[:20]]

    def bad(text):
        words = re.findall(decontaminate.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))

    docs = document_rows(spark, texts)
    want = [i for i, t in enumerate(texts) if not bad(t)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.uncontaminated(spark, docs, SF).collect()) == want and len(want) < len(texts) - 15


def test_pii_stage_changes_the_planted_parts_alone(spark):
    """Texts of known pieces: what is private is replaced, alike wherever it stands, and every other character stays."""
    private = ["joe.doe@mail.example.org", "+44 20 7946 0958", "4111-1111-1111-1111", "10.20.30.40", "123-45-6789", "Mrs. Clara Oswald", "Mr. Oswald",
               "fe80:0:0:0:1:2:3:4", "DE89 3704 0044 0532 0130 00", "0123456789abcdef" * 2, "Clara"]
    plain = ["the cat sat, ", "on 12 mats (v1.2) ", "élan \n and Ω ", "no-one@home ", "tel: none; "]
    rng = np.random.default_rng(8)
    pieces = [[(plain[rng.integers(len(plain))], private[rng.integers(len(private) - 1)]) for _ in range(6)] for _ in range(40)]
    texts = ["".join(a + b + " | " for a, b in p) for p in pieces] + plain
    out = {r["doc_id"]: r for r in corpus_pipeline.pseudonymous(spark, document_rows(spark, texts), SF).collect()}
    seen = {}
    for i, parts in enumerate(pieces):
        left = out[i]["text"]
        assert out[i]["n_chars"] == len(left)
        for a, b in parts:
            assert left.startswith(a), (left, a)
            now, left = left[len(a) :].split(" | ", 1)
            assert now != b and seen.setdefault(b, now) == now
            assert re.sub(r"\w", "x", now) == re.sub(r"\w", "x", b) or b.startswith("Mr") or b.count(".") == 3
    assert len(set(seen.values())) == len(seen) and all(out[len(pieces) + i]["text"] == t for i, t in enumerate(plain))
    assert seen["Mrs. Clara Oswald"].split()[-1] == seen["Mr. Oswald"].split()[-1]


def test_mixing_stage_gives_runs_of_words_in_the_planned_amounts(spark):
    docs = table(spark, SF, "documents")
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = Counter()
    for i, w in words.items():
        sizes[source[i]] += len(w)
    # Shares by weight; what is above three times a source's size goes to the others, until none is above.
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, full = {}, {s for s in names if not sizes[s]}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        above = {s for s in names if target[s] > 3 * sizes[s] + 1e-6}
        if not above:
            break
        full |= above
    rows = corpus_pipeline.mixed(spark, docs, SF).collect()
    got, per = Counter(), Counter()
    for r in rows:
        run = r["text"].split(" ")
        assert run == words[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]] and r["source"] == source[r["doc_id"]]
        got[r["source"]] += len(run)
        per[r["doc_id"]] += len(run)
    assert all(got[s] == pytest.approx(target[s], abs=1) for s in names) and all(n <= 3 * len(words[i]) for i, n in per.items())


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if n < 4:
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    assert docs.count() and not docs.filter(F.col("text").rlike(r"555-\d{4}")).count()
