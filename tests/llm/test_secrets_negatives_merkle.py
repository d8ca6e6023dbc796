"""Secret scan, hard negatives and the Merkle manifest beside plain versions, and the odd inputs."""

import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recspark.llm import merkle, negatives, secretscan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, tree string, spans string, n long, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y", 7, "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, columns with names that operators use inside."""
    long = "a" * 200_000 + " " + "token = " + "9f" * 50_000 + " " + "x.y" * 50_000
    rows = [(1, "Password: hunter2hunter2 Ä", "en", "a", 3), (1, "Password: hunter2hunter2 Ä", "en", "a", 3), (2, None, None, None, None),
            (3, "", "", "", 0), (None, "token=abc", "fr", "b", 9), (4, long, "en", None, 1), (None, None, None, None, None), (5, "B", "e", "a", 1)]
    return frame(spark, rows)


# Secrets


def plain_base(text):
    """kind, start, end of the fixed shapes, by the regular expressions of the definition."""
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def spans_of(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r["doc_id"]].append([(s["start"], s["kind"], s["end"]) for s in r["spans"]])
    return out


def test_fixed_shapes_equal_plain_expressions(spark, odd):
    parts = ["token", "TOKEN=", "api_key", "ApiKey : ", "secret\"='", "passwd", " ", "  ", ":", "=", "'", "AKIA", "AKIAAKIA", "0123456789ABCDEF", "deadbeef", "e" * 31,
             "f" * 33, "ſecret=abcdefghij", "toKen=12345678", "é😀", "password:", "zyxwvuts", ".", "-", "\n"]
    pick = random.Random(3)
    texts = ["".join(pick.choices(parts, k=pick.randrange(1, 40))) for _ in range(400)]
    got = spans_of(secretscan.scan(frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])))
    for i, text in enumerate(texts):
        assert [s for s in got[i][0] if s[1] < 3] == plain_base(text), text
    got = spans_of(secretscan.scan(odd))
    for r in odd.select("doc_id", "text").distinct().collect():
        if r["doc_id"] is not None:
            assert all([s for s in spans if s[1] < 3] == plain_base(r["text"]) for spans in got[r["doc_id"]])
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and len(got[None]) == 2
    assert secretscan.scan(odd.limit(0)).count() == 0


def test_random_tokens_are_found_and_ordinary_ones_are_not(spark):
    pick = random.Random(11)
    words = "the house of an old sailor near every river stood alone while another morning came with rain and wind over hills".split()
    kinds = {"base64": string.ascii_letters + string.digits + "+/", "base62": string.ascii_letters + string.digits, "base32": string.ascii_uppercase + "234567",
             "HEX": "0123456789ABCDEF"}
    rows, secrets, others = [], [], []
    for i in range(600):
        prose = " ".join(pick.choices(words, k=30))
        secret = "".join(pick.choices(kinds[pick.choice(list(kinds))], k=64)) if i % 3 == 0 else None
        plain = pick.choice(["", "-", "_"]).join(pick.choices(words, k=14)) if i % 3 == 1 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if i % 30 == 2 else "a1" * 30
        if secret:
            secrets.append((i, len(prose) + 1, len(prose) + 65))
            rows.append((i, f"{prose} {secret}, {prose}", "en", "a", 1))
        else:
            others.append(i)
            rows.append((i, f"{prose} {plain}; {prose}", "en", "a", 1))
    got = spans_of(secretscan.scan(frame(spark, rows)))
    found = {(i, s, e) for i in got for spans in got[i] for s, kind, e in spans if kind == 3}
    assert sum(s in found for s in secrets) >= 0.9 * len(secrets)
    assert len(found - set(secrets)) <= 0.02 * len(found)


def test_added_spans_keep_off_fixed_ones(spark):
    pick = random.Random(5)
    rows = []
    for i in range(300):
        secret = "".join(pick.choices(string.ascii_letters + string.digits, k=60))
        rows.append((i, f"api_key: {secret} and {secret}" if i % 2 else f"words {'ab' * 40}" + secret, "en", "a", 1))
    got = spans_of(secretscan.scan(frame(spark, rows)))
    for i, spans in got.items():
        fixed = [(s, e) for s, k, e in spans[0] if k < 3]
        added = [(s, e) for s, k, e in spans[0] if k == 3]
        assert fixed and not any(s < b and a < e for s, e in added for a, b in fixed)
    assert sum(any(k == 3 for _, k, _ in got[i][0]) for i in range(1, 300, 2)) > 140


# Hard negatives


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 70), st.integers(0, 70), st.integers(0, 70), st.integers(1, 9))
def test_recursive_product_equals_plain_product(rows, inner, columns, leaf):
    draw = np.random.default_rng(rows * 7 + inner * 3 + columns)
    a, b = draw.integers(-(2**27), 2**27, (rows, inner)), draw.integers(-(2**27), 2**27, (inner, columns))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


def plain_negatives(rows):
    kept = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * v)) for v in x])
        kept[i] = min(kept.get(i, row), row)

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a in (i for i in kept if i % 50 == 0):
        others = sorted((-score(kept[a][1], v), i, label) for i, (label, v) in kept.items() if i != a)
        for loss, p, _ in [o for o in others if o[2] == kept[a][0]][:5]:
            window = [o for o in others if o[2] != kept[a][0] and 50 * -loss <= 100 * -o[0] <= 95 * -loss]
            out += [(a, p, n + 1, i, -loss, -s) for n, (s, i, _) in enumerate(window[:3])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(3, 1), (1000, 1000)])
def test_negatives_equal_plain_version(spark, blocks):
    draw = np.random.default_rng(1)
    rows = [(i, [float(v) for v in np.round(draw.normal(size=5 if i % 9 else 3) / 2, 1)], int(draw.integers(0, 4))) for i in range(301)]
    rows += [(50, rows[50][1], 9), (400, None, 1), (450, [1.0, None], 1), (500, [float("nan")], 1), (550, [float("inf")], 2), (600, [0.5, 0.5], None),
             (None, [1.0], 1), (650, [], 1), (700, [0.0] * 5, 2), (7, rows[8][1], 3)] + rows[100:130]
    table = spark.createDataFrame([(*r, 1, 2, "q") for r in rows], "vec_id long, embedding array<double>, label int, block int, heap int, near string")
    got = negatives.mine(table, rows_per_block=blocks[0], anchors_per_block=blocks[1]).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows) and len(got) > 50
    assert negatives.mine(table.limit(0)).count() == 0


# Merkle manifest


def test_places_in_the_log_follow_from_sizes():
    for n in [*range(1, 70), 255, 256, 257, 300, 4095, 4096]:
        levels = merkle.height(n)
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        log = merkle.appended(leaves, levels)
        row, seen = leaves, set()
        for level in range(levels + 1):
            for i, node in enumerate(row):
                place = merkle.position(level, i, n, levels)
                assert log[place] == node
                seen.add(place)
            if level < levels:
                row = [merkle.digest_of(row[i : i + 16]) for i in range(0, len(row), 16)]
        assert len(row) == 1 and seen == set(range(len(log)))


def plain_proofs(rows):
    def h(s):
        return hashlib.sha256(s.encode()).hexdigest()

    def leaf(r, small=False):
        i, text, lang, source, n = r
        if small and text is not None:
            text = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def climb(nodes):
        """The root, and for every leaf the siblings (before, after) by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for p, i in zip(paths, at):
                p.append(("".join(runs[i // 16][: i % 16]), "".join(runs[i // 16][i % 16 + 1 :])))
            at = [i // 16 for i in at]
            nodes = [h("".join(run)) for run in runs]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[(b"0" if r[3] is None else b"1" + r[3].encode())].append(r)
    subs = {}
    for g, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[g] = climb([leaf(r) for r in members])
    names = sorted(groups)
    root, tops = climb([subs[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for r, path in zip(groups[g], subs[g][1]):
            path = path + top
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for before, after in path:
                node = h(before + node + after)
            out.append((r[0], leaf(r), subs[g][0], root, h("".join(b + a for b, a in path)), node, node == root))
    return out


def key(r):
    return tuple(map(str, r))


def test_proofs_equal_plain_version(spark, odd):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in odd.collect()]
    # One source of two tiers of pieces, many of one document, and one of exactly a full run.
    rows += [(10 + i, f"Text {i}", "de", "big", i) for i in range(4200)] + [(9000 + i, "T", None, f"s{i}", i) for i in range(20)]
    rows += [(9100 + i, "U", "", "é", None) for i in range(16)]
    got = merkle.proofs(merkle.manifest(frame(spark, rows))).collect()
    assert sorted(map(key, got)) == sorted(map(key, plain_proofs(rows)))
    assert merkle.proofs(merkle.manifest(odd.limit(0))).count() == 0
    one = merkle.proofs(merkle.manifest(odd.filter("doc_id = 5"))).collect()
    assert one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_log_of_a_source_is_in_postorder(spark):
    docs = frame(spark, [(i, str(i), "en", "a", 1) for i in range(4100)])
    m = merkle.manifest(docs)
    found = {r["position"]: r for r in merkle.nodes(m).collect()}
    leaves = [bytes(r["digest"]) for r in m.leaves.orderBy("place").collect()]
    log = merkle.appended(leaves, merkle.height(len(leaves)))
    assert [found[i]["digest"] for i in range(len(log))] == [d.hex() for d in log] and len(found) == len(log)
    assert found[len(log) - 1]["level"] == 4
