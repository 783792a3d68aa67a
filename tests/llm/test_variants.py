import pytest

from lamina.llm import variants as v


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("", "x"), ("abcde", "ace"), ("nganhang", "nganhagn"), ("aaaa", "aa"), ("xyz", "abc")])
def test_lcs(a, b):
    assert v.lcs(a, b) == brute_lcs(a, b)


@pytest.mark.parametrize(
    ("name", "tokens"),
    [
        ("Giám quản Tín dụng, Ủy ban", ["uy", "ban", "giam", "quan", "tin", "dung"]), ("PGS.TS Mạc Trọng  Luân Tài", ["mac", "trong", "luan", "tai"]), ("CaoLệHươngHòa", ["cao", "le", "huong", "hoa"]),
        ("Uyr ban Giams quanr Tins dungj", ["uy", "ban", "giam", "quan", "tin", "dung"]), ("Bùi H.L. Hòa", ["bui", "h.", "l.", "hoa"]), ("", []), ("  ", []),
    ],
)
def test_reading(name, tokens):
    assert v.read_name(name)[0] == tokens


def test_aliases():
    assert v.read_name("Ngân hàng Điều tiết Quốc gia (NHĐQ)")[1] == [["nhdq"]]
    assert v.read_name("Nhà băng Điều tiết – NHĐQ") == (["nha", "bang", "dieu", "tiet"], [["nhdq"]])


def test_resemblance():
    name = ("chau", "ke", "tuong", "oanh")
    assert v.resemblance(("chau", "k.", "t.", "oanh"), name) > 0.9 and v.resemblance(("chau", "tuong", "oanh"), name) > 0.9
    assert v.resemblance(("chua", "ke", "tuong", "oanh"), name) > 0.85 and v.resemblance(("la", "sy", "long", "thach"), name) == 0
    assert v.resemblance(("khu", "vuc", "3"), ("khu", "vuc", "8")) == 0


def test_table(spark):
    a = ["Châu Kế Tường Oanh", "CHÂU KẾ TƯỜNG OANH", "chau ke tuong oanh", "ChâuKếTườngOanh", "Châu K.T. Oanh", "Châu Tường Oanh", "Oanh, Châu Kế Tường", "Châu Kế Tường Onah", "Châu Kế Tường Oanh (Út Muối)", "Út Muối"]
    b = ["Châu Phúc Nghĩa Phi", "CHÂU PHÚC NGHĨA PHI", "chau phuc nghia phi", "Châu P. N. Phi"]
    c = ["Chi nhánh Khu vực 3", "Chi nhánh Khu vực 8", "CHI NHÁNH KHU VỰC 8", "CHI NHÁNH KHU VỰC 3", "chi nhanh khu vuc 3", "chi nhanh khu vuc 8"]
    rows = [(x, "NguoiKy") for x in (a + b) for _ in range(3 if x in (a[0], b[0]) else 1)] + [(x, "CoQuan") for x in c] + [(None, "CoQuan"), ("", "CoQuan"), (a[0], "NguoiKy")]
    linked = v.link_variants(spark.createDataFrame(rows, "name string, kind string"))
    groups = {}
    for r in linked.collect():
        groups.setdefault(r.component, set()).add(r.name)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [set(a), set(b), {x for x in c if "3" in x}, {x for x in c if "8" in x}, {""}]))
    pairs = [(r.name_1, r.name_2) for r in v.variant_pairs(linked).collect()]
    assert len(pairs) == len(set(pairs)) == 45 + 6 + 3 + 3 and all(x < y for x, y in pairs)


def test_empty(spark):
    assert v.link_variants(spark.createDataFrame([], "name string, kind string")).count() == 0


def test_large_blocks_meet_the_same_names(spark, monkeypatch):
    names = ["Ngân hàng Điều tiết Quốc gia"] * 9 + ["Ngân hàng Điều tiết Quốc gia."] * 3 + ["NGÂN HÀNG ĐIỀU TIẾT QUỐC GIA"] * 3 + ["Ngân hàng Điều tiết", "Mgân hàng Điều tiết Quốc gia", "Quốc gia, Ngân hàng Điều tiết"]
    rows = spark.createDataFrame([(n, "CoQuan") for n in names], "name string, kind string")
    groups = v._groups(v.spellings(rows))
    want = {(r.g, r.h) for r in v._candidates(groups).collect()}
    monkeypatch.setattr(v, "BLOCK_LIMIT", 1)
    got = v._candidates(groups).collect()
    assert want and {(r.g, r.h) for r in got} == want and len(got) == len(want)
