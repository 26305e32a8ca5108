from pyspark.sql import functions as F

from tomeflow.functions import formulas, labels, text
from tomeflow.functions.stutter import clean_ocr


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def test_content_tokens(spark):
    assert one(spark, "What is an electric dipole?", text.content_tokens) == ["electric", "dipole"]
    assert one(spark, "What is a solution?", text.content_tokens) == ["solution"]
    assert one(spark, "solutions, properties, charges", text.content_tokens) == ["solution", "property", "charge"]
    assert one(spark, "what is the?", text.content_tokens) == []
    assert one(spark, "what is the?", text.has_content) is False


def test_names(spark):
    assert one(spark, "7.2 Integration of the Functions", text.canonical_name) == "integration functions"
    assert one(spark, "e lectric c harge", text.canonical_name) == "electric charge"
    assert one(spark, "a bc d ef", text.canonical_name) == "abc def"
    assert one(spark, "Matrix Matrix", text.canonical_name) == "matrix"
    assert one(spark, "ELECTRIC FIELD (contd.)", text.display_name) == "Electric Field"
    ok = lambda s: one(spark, s, lambda c: text.accepts_name(c, text.canonical_name(c)))
    assert ok("Electric Field") and not ok("Introduction") and not ok("If the charge moves then stop")


def test_nfkc_and_stutter(spark):
    assert one(spark, "ﬁeld ①", text.nfkc) == "field 1"
    assert one(spark, "E LECTRIC C HARGES electric field electric field", clean_ocr) == "ELECTRIC CHARGES electric field"
    assert one(spark, "a b a b c c", clean_ocr) == "a b c"


def test_labels(spark):
    ask = lambda s: spark.createDataFrame([(1, s)], "query_id int, query string")
    p = lambda s: labels.profile(ask(s)).first()
    r = p("How do I solve a matrix?")
    assert (r.question_type, r.type_rule, r.intent) == ("worked_example", "solve_override", "worked_example")
    assert p("difference between speed and velocity").intent == "comparison"
    assert p("why does charge move").question_type == "conceptual_reasoning"
    assert p("electric field and magnetic flux").subject == "physics"
    assert p('what is "electric field"').is_quoted


def test_follow_up(spark):
    said = lambda s: spark.createDataFrame([(s, "vectors")], "q string, a string").select(labels.follow_up(F.col("q"), F.col("a")).alias("f")).first()["f"]
    assert said("give me another example").rewritten == "Show me a worked example of vectors."
    assert said("more examples of matrices").rewritten == "Show me a worked example of matrices."
    assert said("calculate 2 + 2").rule == "computation"
    assert said("dot product").rewritten == "dot product about vectors"


def test_formulas(spark):
    assert one(spark, "A = [1 2; 3 4]", formulas.to_words) == "2x2 matrix"
    assert one(spark, "H2O + NaOH", formulas.to_words) == "water + sodium hydroxide"
    assert one(spark, "angle θ ≤ π", formulas.to_words) == "angle theta less than or equal to pi"
    assert one(spark, "plain words", formulas.describe) is None
    assert one(spark, "F = ma", formulas.rewrite) == "Newton's second law"
