import re
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_base_against_brute_force(spark, small, odd):
    more = spark.createDataFrame([(50, "a b c d e f g h " * 9), (51, "x\n\n x\nx\n" * 3), (52, " ".join(map(str, range(400))) + " " + " ".join(map(str, range(30, 90)))), (53, "\x0b\x0c a b   c"), (54, "a b c d e f g h a b c d e f g h"), (55, "a " * 15), (56, "w " * 5000)], "doc_id long, text string")
    for docs in (small.select("doc_id", "text"), odd.select("doc_id", "text"), more):
        want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
        got = Counter(tuple(r)[:7] for r in quality.assess(docs).collect())
        assert got == want


def test_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality.assess(docs).join(docs.select("doc_id", "quality"), "doc_id").filter("not base_failed")
    kept = {r.quality: r.k for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] == 1.0 and kept[0] < 0.1


def test_failed_rules_are_named(spark):
    docs = spark.createDataFrame([(1, "the of and " * 4 + " ".join(f"$$$ %%% w{i}" for i in range(40))), (2, " ".join(f"zq{i}x" for i in range(50))), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert "symbols" in rows[1].failed and rows[2].failed == ["few_stop_words"] and not rows[3].kept


def test_rules_speak_of_their_scripts_only(spark):
    texts = {
        1: "Это простой текст на русском языке который говорит о погоде и о том как люди живут в большом городе зимой когда холодно и рано темнеет",
        2: "我们 " + "今天天气很好我们去公园散步然后回家吃饭" * 3 + "。 " + " ".join(f"第{k}章节内容很多很多很多很多很多很多很多很多很多" for k in range(25)),
        3: "Bu sabah erken kalktım ve pencereyi açtım çünkü hava çok güzeldi sonra bir kahve içtim ve uzun bir yürüyüş için dışarı çıktım",
        4: "Wczoraj wieczorem poszliśmy na spacer nad rzekę i długo rozmawialiśmy o tym co nas czeka w nowym roku bo nie było nam zimno",
    }
    rows = {r.doc_id: r for r in quality.assess(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(rows[k].kept for k in texts), {k: r.failed for k, r in rows.items()}


def test_one_projection(small):
    plan = small.sparkSession._jvm.PythonSQLUtils.explainString(quality.assess(small)._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty(empty):
    assert quality.assess(empty).count() == 0
