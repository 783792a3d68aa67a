import pytest

from lamina.llm import encoding

PLAIN = "Ngân sách dành cho phòng chống rửa tiền năm nay là 12,5 tỷ đồng, được giữ ở mức – tùy điều kiện."


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1258", "mac_roman", "cp437", "cp850", "cp1251"])
def test_round_trip_through_code_pages(page):
    back = {v: k for k, v in encoding._byte_of(page).items()}
    wrong = "".join(chr(back[chr(b)]) if b >= 0x80 and chr(b) in back else chr(b) for b in PLAIN.encode("utf-8"))
    assert wrong != PLAIN
    garbled, restored, kinds = encoding.restore("Đoạn đúng. " + wrong)
    assert garbled and restored == "Đoạn đúng. " + PLAIN and "multibyte" in kinds


def test_twice_garbled():
    back = {v: k for k, v in encoding._byte_of("cp1252").items()}
    once = "".join(chr(back[chr(b)]) if b >= 0x80 else chr(b) for b in PLAIN.encode("utf-8"))
    twice = "".join(chr(back[chr(b)]) if b >= 0x80 else chr(b) for b in once.encode("utf-8"))
    assert encoding.restore(twice)[1] == PLAIN


def test_fonts():
    assert encoding.restore("§iÒu 19. Côc Thanh tra TÝn dông MiÒn Trung tr¶ lêi: hå s¬ hîp lÖ")[1] == "Điều 19. Cục Thanh tra Tín dụng Miền Trung trả lời: hồ sơ hợp lệ"
    assert encoding.restore("töø vaø ñöôïc caùn boä thaåm ñònh kyù xaùc nhaän")[1] == "từ và được cán bộ thẩm định ký xác nhận"


@pytest.mark.parametrize("text", [PLAIN, "", "Ação Fácil, Größenweg, façade, naïve", "«Банк речного развития»", "“TÂN HÀ”, “LÃM”, “À, mã quầy…”", "ÂME & Ça va – see “Ãnglo”", "株式会社竹川", "CO₂, 10⁶, Σ β Δ", "Ðiều 5 quy ðịnh ðã ðược", "Có không? Vì sao? Hỏi: gì?"])
def test_honest_texts(text):
    assert encoding.restore(text) == (False, text, "")


def test_lost_characters():
    assert encoding.restore("Kho��n ph�t")[::2] == (True, "replaced")
    assert encoding.restore("Ph?n ch?nh l?ch ???c ghi nh?n v?o chi ph?")[::2] == (True, "question")


def test_table(spark):
    rows = [("a", None, True), ("b", "", True), ("c", "tiá»\x81n gá»\xadi " * 5000, True), ("c", "tiá»\x81n gá»\xadi " * 5000, True), ("d", "sạch", False)]
    df = spark.createDataFrame(rows, "id string, text string, text_garbled boolean")
    got = [(r.id, r.text_garbled, None if r.text_restored is None else len(r.text_restored)) for r in encoding.repair_encoding(df).orderBy("id").collect()]
    assert got == [("a", False, None), ("b", False, 0), ("c", True, 45000), ("c", True, 45000), ("d", False, 4)]
    assert encoding.repair_encoding(df.limit(0)).count() == 0


def test_any_number_of_rounds():
    text = "Giới hạn tín dụng"
    garbled = text
    for _ in range(6):
        garbled = garbled.encode("utf-8").decode("latin-1")
    assert encoding.undo_utf8(garbled)[0] == text
