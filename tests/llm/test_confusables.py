import unicodedata

import pytest

from lamina.llm import confusables as c

R = c.Rewriter(c.representatives({"a": 9, "đ": 5}))


@pytest.mark.parametrize(
    ("stored", "form"),
    [
        ("Ｂên ｖａｙ １２％", "Bên vay 12%"), ("𝐝𝐨𝐚𝐧𝐡 𝗌𝖺𝗂", "doanh sai"), ("сó 21 vụ, Вến Sỏi", "có 21 vụ, Bến Sỏi"), ("Τòa án, Νợ", "Tòa án, Nợ"), ("ng​ân h\xadàng﻿", "ngân hàng"),
        ("tài sản bảo đảm", "tài sản bảo đảm"), (unicodedata.normalize("NFD", "Điều tiết"), "Điều tiết"), ("ðồng Ɖiều ɖịnh", "đồng Điều định"), ("staﬀ Oﬃce ﬁle", "staff Office file"), ("2О24", "2O24"), ("Mò̂ng", "Mồng"),
    ],
)
def test_disguises(stored, form):
    assert R.rewrite(stored) == form


@pytest.mark.parametrize("text", ["", "«Банк речного развития»", "Τράπεζα Νήσου", "株式会社竹川（株）", "Sai số Δ nhỏ hơn ε, tổng Σ, hệ số β, độ lệch σ", "10⁶ m² CO₂ ½", "“trích” – — … ‘a’", "Größenweg façade naïve Ação", "12 × 10"])
def test_genuine_text(text):
    assert R.rewrite(text) == text


def test_classes_are_transitive_and_ties_defined():
    group = next(g for g in c.look_alikes() if "а" in g)
    assert {"a", "ａ", "𝐚", "а", "α"} <= set(group)
    assert c.representatives({})["а"] == "a" and c.representatives({"a": 1, "а": 99})["а"] == "a"


def test_table(spark):
    rows = [("a", None, 1), ("b", "", 1), ("c", "сó", 1), ("c", "сó", 1), ("d", "có " * 40_000 + "сó", 1), ("e", "Má»©c phÃ\xad Ã¡p dá»¥ng", 1)]
    df = spark.createDataFrame(rows, "id string, text string, text_form int")
    rules = c.learn_rules([(df, "text")])
    got = sorted({(r.id, r.text_disguised) for r in c.unify(df, "text", rules).collect()})
    assert got == [("a", False), ("b", False), ("c", True), ("d", True), ("e", False)]
    assert c.learn_rules([(df.limit(0), "text")])["а"] == "a" and c.unify(df.limit(0), "text", rules).count() == 0


def rules_of(spark, *texts):
    return c.learn_rules([(spark.createDataFrame([(t,) for t in texts], "text string"), "text")])


def test_the_corpus_shows_edges(spark):
    """A Coptic letter that no list names stands for the letter that its words have elsewhere; which one, the counts decide."""
    odd = "ⲟ"
    base = "khoản vay bảo đảm ngoài hồ sơ"
    as_o = f"kh{odd}ản b{odd} đ{odd}àn v{odd}i nh{odd}m"
    assert odd not in c.representatives({})
    assert rules_of(spark, base + " đoàn voi nhom", as_o)[odd] == "o"
    assert rules_of(spark, "khưản đưàn vưi nhưm", as_o)[odd] == "ư"
    assert odd not in rules_of(spark, "khoản đoàn voi khưản đưàn vưi", as_o)  # as many for the one as for the other
    assert odd not in rules_of(spark, "khoản đoàn", as_o)  # too few
    assert rules_of(spark, "file firms fish ile irms ish", "\ufb01le \ufb01rms \ufb01sh")["\ufb01"] == "fi"
    r = c.Rewriter(rules_of(spark, base + " đoàn voi nhom", as_o))
    assert r.rewrite(f"H{odd}{odd}, kh{odd}ản") == "Hoo, khoản"


def test_counts_choose_among_rivals_but_never_a_compatibility_form():
    group = next(g for g in c.look_alikes() if "γ" in g)
    assert c.representatives({"ℽ": 99})["ℽ"] == "γ" and len(group) > 1
    rivals = [g for g in c.look_alikes() if sum(unicodedata.normalize("NFKC", m) == m for m in g) > 1 and not any(m.isascii() or m in c.LETTERS for m in g)]
    for members in rivals[:5]:
        a, b = [m for m in members if unicodedata.normalize("NFKC", m) == m][:2]
        assert c.representatives({ch: 5 for ch in a})[b] == a and c.representatives({ch: 5 for ch in b})[a] == b


def test_rewriting_ends_at_a_fixed_point():
    text = "".join(["ﬀ" * 5, "Ａ" * 5, "о̂" * 5])
    form = R.rewrite(text)
    assert R.rewrite(form) == form
