import random

from palimpsest.llm.quality import STATS, line_kinds, quality, text_stats

WORDS = "the team of the project said that it was a long day and they have to wait for the next release because there is no time".split()


def prose(rng, n):
    return " ".join((" ".join(rng.choice(WORDS) for _ in range(rng.randint(7, 15))) + ".").capitalize() for _ in range(n))


def test_lines():
    assert line_kinds(["- a b", "1) c", "[ ] d", "#x, #y"]) == ["list"] * 4
    assert line_kinds(["id;hits;score", "a;1;2", "b;;3"]) == ["table"] * 3
    assert line_kinds(["a   1   2", "b   3   4"]) == ["table"] * 2
    assert line_kinds(["00000010  e3 4b b1 a4 8c e3", "0x7bd897611ae86000 in ?? ()"]) == ["machine"] * 2
    assert line_kinds(["He came, saw, and left, again.", "She, too, was there, I think."]) == ["text"] * 2
    assert line_kinds(["Kranin ?", "Vebemond", "Berkan (open)", "Tritest ?"]) == ["list"] * 4


def test_stats():
    assert text_stats(None) is None and text_stats(" \n\t ") is None
    lang, s = text_stats("Das ist ein Test, und er ist nicht lang.")
    assert lang == "de" and len(s) == len(STATS)
    assert text_stats("在测试环境里，整理任务会合并冲突的笔记。")[0] == "zh" and text_stats("###")[0] == "none"
    assert len(text_stats("x" * 300_000)[1]) == len(STATS)


def test_classes(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(3, 20))) for i in range(200)]
    rows += [(300, "\n".join(f"- {w} {i}" for i, w in enumerate(WORDS))), (301, "\n".join(f"{w};{i};0.{i};x" for i, w in enumerate(WORDS))), (302, "lorp " * 200), (303, "#$%&/()=" * 60), (304, prose(rng, 12) + "\n- one thing\n- two things\n" + prose(rng, 6))]
    rows += [(305, None), (306, ""), (307, "  "), (None, prose(rng, 5)), (300, rows[200][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as stats", "2 as language")
    out = quality(df).collect()
    got = {r["doc_id"]: r["text_class"] for r in out}
    assert {k: got[k] for k in (300, 301, 302, 303, 304)} == {300: "list", 301: "table", 302: "junk", 303: "junk", 304: "prose"}
    assert not {305, 306, 307} & set(got) and all(got[i] == "prose" for i in range(200)) and sum(r["doc_id"] == 300 for r in out) == 2
    for r in out:
        assert abs(sum(r["contributions"]) - r["distance"] ** 2) < 1e-6 * (1 + r["distance"] ** 2)


def test_a_language_with_few_texts_is_prose(spark):
    """French among English texts: its few texts are measured against the fit of all."""
    rng = random.Random(6)
    french = "le projet est en retard parce que la mise à jour ne passe pas sur les serveurs et nous avons dû attendre la version qui vient avec ce correctif".split()
    rows = [(i, prose(rng, rng.randint(3, 20))) for i in range(200)]
    rows += [(300 + k, " ".join((" ".join(rng.choice(french) for _ in range(rng.randint(7, 15))) + ".").capitalize() for _ in range(9))) for k in range(4)] + [(400 + k, "na " * 300) for k in range(40)]
    out = {r["doc_id"]: r for r in quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {out[300 + k]["language"] for k in range(4)} == {"fr"} and {out[300 + k]["text_class"] for k in range(4)} == {"prose"}
    assert {out[400 + k]["text_class"] for k in range(40)} == {"junk"}


def test_start_follows_the_spread_of_the_data(spark):
    """The start region comes from the median absolute deviation: wide where texts differ, whatever the floors."""
    from palimpsest.llm import quality as q

    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(3, 20))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    wide = {k: v for k, v in q.FLOORS.items()}
    try:
        q.FLOORS.update({k: v / 4 for k, v in wide.items()})
        assert all(r["text_class"] == "prose" for r in quality(df).collect())
    finally:
        q.FLOORS.update(wide)


def test_empty(spark):
    assert quality(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    one = quality(spark.createDataFrame([(1, "12 34")], "doc_id bigint, text string")).collect()
    assert len(one) == 1
