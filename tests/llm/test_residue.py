import pytest

from lamina.llm import residue

PROSE = [
    "Điều 5. Tổ chức tín dụng lập báo cáo hằng quý và gửi trước ngày 12 tháng 3.", "Khách hàng hỏi vì sao hồ sơ vay vốn bị trả lại, cán bộ giải thích rằng thiếu chữ ký.", "Lãi suất do hai bên thỏa thuận và ghi vào hợp đồng.",
    "Biên bản ghi nhận máy in lỗi hai lần trong phiên họp.", "The borrower may request an extension of 20 months.", "Thủ quỹ trả lại hồ sơ thiếu vào ngày 3 tháng 9.", "NGÂN HÀNG PHÁT TRIỂN", "Số: 12/2020/TT-ABC", "Chủ trì: trưởng phòng kho quỹ",
]


@pytest.fixture(scope="module")
def model():
    return residue.train([residue.mask(x) for x in PROSE])


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_verdicts(model):
    said = lambda x: model.verdict(residue.mask(x))
    assert {said(x) for x in ("404 Not Found", "Không tìm thấy tài liệu này. Vui lòng quay lại trang chủ.", "KeyError: 'noi_dung'", "Người dùng không có quyền tải tài liệu này mã 7.")} == {"message"}
    assert {said(x) for x in ("amet elit tempor magna " * 30, "test test 99", "Phần này sẽ bổ sung sau.", "Dummy text number 60. Replace before release.")} == {"filler"}
    assert {said(x) for x in ("Trang chủ | Công báo | Liên hệ", "© Cổng Công báo")} == {"furniture"}
    assert {said(x) for x in (*PROSE, "Chưa từng gặp các từ này bao giờ hết", "")} == {"prose"}


def test_templates_have_wildcards():
    shape, alike = residue.template(["bài này đã bị gỡ, mã #.", "trang này đã bị gỡ, mã #."])
    assert shape == "<*> này đã bị gỡ, mã #." and alike == pytest.approx(6 / 7)
    assert residue.matches("tệp này đã bị gỡ, mã #.", shape) and not residue.matches("tệp này đã bị xóa, mã #.", shape) and not residue.matches("này đã bị gỡ, mã #.", shape)


def test_a_line_that_is_unlike_its_leaf_is_judged_by_itself(spark, model):
    # the same size, first four tokens and last token, but another text
    rows = ["không tìm thấy trang nào cũ hơn này"] * 3 + ["không tìm thấy trang chủ hoặc liên này"]
    lines = residue.lines_of(residue.look_at(documents(spark, rows), "doc_id", "text", model))
    assert lines.count() == 4
    assert lines.select("__leaf").distinct().count() == 1
    own = {x: model.verdict(x) for x in set(rows)}
    assert [r.verdict for r in residue.judge_lines(lines, model).orderBy("__id").collect()] == [own[x] for x in rows]


def test_documents(spark, model):
    long = "Điều 5. Tổ chức tín dụng lập báo cáo hằng quý và gửi trước ngày 12 tháng 3. " * 3
    texts = [
        "Trang chủ | Tra cứu | Liên hệ\n503 Service Unavailable", long + "\nLorem ipsum dolor sit amet, consectetur adipiscing elit.", long + " Bên vay: {{ten_ben_vay}}.", long, None, "", "  \n ",
        long + "\nAccess denied", "[ ] có [ ] không, xem (1) và <3", "{{" + "x" * 5000 + "}}", "Hãy bật JavaScript để xem trang này. " * 40,
    ]
    got = {r.doc_id: r for r in residue.judge_documents(documents(spark, texts), model=model).collect()}
    assert set(got) >= {0, 1, 2, 9, 10} and not set(got) & {3, 4, 5, 6, 7}
    assert got[0].message_share == 1.0 and got[1].filler_lines == 1 and got[2].has_slot and got[9].has_slot


def test_slots(spark):
    real = "Giới hạn tín dụng với một nhóm khách hàng liên quan không vượt quá 21,5% vốn tự có."
    slots = ["{{ho_ten}}", "{% if so_tien %}", "<%= signer %>", "<<Tên bên vay>>", "[[branch]]", "${ngay_ky}", "$loan_amount$", "$HO_TEN", "%SO_TIEN%", "%(ten)s", "__LAI_SUAT__", "#TIEU_DE#", ":so_tien:", "@Model.ho_ten", "&lt;DIA_CHI&gt;", "[Số hợp đồng]", "{Điền sau}", "<Insert date>", "«Điền sau»", "[●]", "[___]", "{0}", "{1:N2}", "XX/XX/20XX", "[DIA_CHI]", "[Số " + "x" * 300 + "]"]
    fair = ["«Банк речного развития»", "[12]", "[…]", "{A} là nợ nhóm một, <C> là nợ", "a < b và c > 9", "Họ và tên: ............", "giá 5 USD: 10 %", "#1", "x: y:", "5% và 6%", "email a@b.vn"]
    rows = documents(spark, [f"{real} {x} hết." for x in slots + fair])
    got = {r.doc_id for r in rows.filter(residue.has_slot("text")).collect()}
    assert got == set(range(len(slots)))


def test_fitting_on_the_documents_and_empty_tables(spark):
    rows = [x * 40 for x in PROSE] + ["Access denied", None]
    assert [r.doc_id for r in residue.judge_documents(documents(spark, rows)).collect()] == [len(PROSE)]
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert residue.judge_documents(empty).count() == 0
    clash = documents(spark, ["Access denied"]).withColumnRenamed("doc_id", "__leaf")
    assert residue.judge_documents(clash, key="__leaf").count() == 1
