import pytest
from pyspark.sql import functions as F

from recspark.functions.numbers import fixed, rounded
from recspark.functions.replies import parse_replies, with_replied_criteria, with_replied_eco_score
from recspark.functions.rules import eco_keywords, with_eco_score, with_search_criteria
from recspark.functions.text import clean_text
from recspark.functions.vectors import dot, norm, unit


def test_clean_text(spark):
    cases = {
        None: "", "  a \n b ": "a b", "<p>x</p> <b>y</b>": "x y", "a <br> b": "a  b", "1 < 2": "1 < 2",
        " é　è\x1c": "é è", "<>": "<>",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", clean_text(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases


def test_numbers_as_text(spark):
    values = [4.25, 4.35, 2.75, 0.125, 1.0005, -0.0004, 1234.5678, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", *[fixed(F.col("v"), d).alias(f"d{d}") for d in (1, 3, 4)]).collect():
        assert [r["d1"], r["d3"], r["d4"]] == [f"{r['v']:.{d}f}" for d in (1, 3, 4)]
    assert str(df.select(rounded(F.lit(-1e-9)).alias("x")).first()["x"]) == "0.0"


def test_vector_expressions(spark):
    row = spark.sql("SELECT array(3F, 4F) AS a, array(1D, 2D) AS b, array(0F, 0F) AS z").select(
        dot(F.col("a"), F.col("b")), norm(F.col("a")), unit(F.col("a")), unit(F.col("z"))
    ).first()
    assert list(row) == [11.0, 5.0, pytest.approx([0.6, 0.8]), [0.0, 0.0]]


def test_keywords_in_list_order(spark):
    df = spark.createDataFrame([("Green VEGAN, eco-friendly",), ("none",)], "t string")
    assert [r[0] for r in df.select(eco_keywords(F.col("t"))).collect()] == [["eco-friendly", "vegan", "green"], []]


@pytest.mark.parametrize(
    ("title", "description", "score", "reason"),
    [
        ("Chair", "", 5.0, "Évaluation standard"),
        ("Biography", "", 6.0, "matériaux biosourcés"),
        ("We recommend", "", 4.5, "Évaluation standard"),
        ("Green, certifié", "", 5.0, "Évaluation standard"),
        ("GOTS recycled bio B-Corp", "fair trade warranty local vegan durable", 10.0,
         "certification matériaux, matériaux recyclés, matériaux biosourcés"),
        ("Chaise", "liège, réparable, végan", 7.0, "matériaux biosourcés, réparable, végan"),
    ],
)
def test_eco_rules(spark, title, description, score, reason):
    df = spark.createDataFrame([(title, description, None, None)], "title string, description string, category string, brand string")
    row = with_eco_score(df).first()
    assert (row["sustainability_score"], row["short_reason"]) == (score, reason)


DEFAULTS = ["note moyenne ≥ 4.0 étoiles", "avis clients positifs", "produit disponible en stock", "retour gratuit possible"]


def criteria(spark, query, **options):
    df = spark.createDataFrame([(query,)], "query string")
    return with_search_criteria(df, **options).first()["criteria"]


def test_criteria(spark):
    assert criteria(spark, None) == DEFAULTS + DEFAULTS
    bag = criteria(spark, "Sac vert ou noir en cuir, sous 50")
    assert bag == [
        "prix raisonnable ou dans le budget", "cuir authentique ou alternative végan", "couleur noir ou similaire",
        "sac bandoulière ou sac à dos", *DEFAULTS,
    ]
    full = criteria(
        spark, "budget vegan recycled cuir bio rouge light compact premium livraison france garantie sac waterproof",
        has_history=F.lit(True), sustainability_mode=True,
    )
    assert len(full) == 12 and len(set(full)) == 12 and full[0] == "prix raisonnable ou dans le budget"
    green = criteria(spark, "bio", sustainability_mode=True)
    assert green.count("produit durable et éco-responsable") == 1 and len(green) == 8


GOOD = '{"recommendations": [{"rank": 1, "asin": "a", "explanation": "x"}, {"asin": "b"}, {"asin": 7}]}'


@pytest.mark.parametrize(
    ("reply", "asins"),
    [
        (GOOD, ["a", "b", "7"]),
        (f"Sure!\n```json\n{GOOD}\n```\nBye", ["a", "b", "7"]),
        (f"Sure: {GOOD} done", ["a", "b", "7"]),
        ("{'recommendations': []}", []),
        ('{"recommendations": [', []),
        ('{"other": 1}', []),
        ('{"recommendations": "none"}', []),
        ("", []),
        (None, []),
    ],
)
def test_replies(spark, reply, asins):
    df = spark.createDataFrame([("q", reply)], "query_id string, reply string")
    rows = parse_replies(df).orderBy("position").collect()
    assert [r["asin"] for r in rows] == asins
    if asins:
        assert [r["explanation"] for r in rows] == ["x", "No explanation provided.", "No explanation provided."]


def test_replied_scores_and_criteria(spark):
    cases = [
        ('{"sustainability_score": 8.7, "short_reason": "r"}', 8.7, "r"),
        ('x {"sustainability_score": -3} y', 0.0, ""),
        ('{"sustainability_score": "high"}', 5.0, "rule"),
        ("nothing", 5.0, "rule"),
        (None, 5.0, "rule"),
    ]
    df = spark.createDataFrame([(i, r, 5.0, "rule") for i, (r, _, _) in enumerate(cases)], "i int, reply string, sustainability_score double, short_reason string")
    got = with_replied_eco_score(df).orderBy("i").collect()
    assert [(r["sustainability_score"], r["short_reason"]) for r in got] == [(s, w) for _, s, w in cases]
    lists = spark.createDataFrame(
        [(n, '{"expanded_criteria": [%s]}' % ", ".join(f'"c{i}"' for i in range(n))) for n in (3, 8, 15)], "n int, reply string"
    ).withColumn("criteria", F.array(F.lit("rule")))
    assert [len(r["criteria"]) for r in with_replied_criteria(lists).orderBy("n").collect()] == [1, 8, 12]
