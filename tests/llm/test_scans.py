import random

from lamina.llm import scans

SENTENCES = [
    "Giới hạn tín dụng với một nhóm khách hàng liên quan không vượt quá 21 phần trăm vốn tự có.", "Quyết toán cuối kỳ phải khớp với giấy báo có và được giao dịch viên ký xác nhận.",
    "Khoản phạt chậm trả tính trên dư nợ gốc, thu cùng kỳ trả nợ gần nhất.", "Hồ sơ chỉ hợp lệ khi chữ ký khớp với mẫu lưu của ngân hàng.", "Nếu quá 30 ngày mà chưa niêm phong chứng từ, khoản nợ được chuyển sang nhóm theo dõi đặc biệt.",
]


def wrap(text, width=60):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) + 1 > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


def pages(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for i in range(60):
        rows.append((i, f"c{i // 5}.pdf", i % 5, False, "\n".join(rng.sample(SENTENCES, 4)), 0))
    for i in range(60, 120):
        text = wrap(" ".join(rng.sample(SENTENCES, 4)))
        kind = i % 4
        if kind == 0:
            text = f"Công báo Ngân khố – Kỳ {i}\n{text}\ntrang {i % 5}"
        elif kind == 1:
            text = text.replace("khớp", "kbớp").replace("nhóm", "rihóm").replace("khi", "kbi")
        elif kind == 2:
            lines = text.split("\n")
            head, _, tail = lines[0].rpartition(" ")
            lines[0] = f"{head} {tail[:2]}-\n{tail[2:]}" if len(tail) > 3 else lines[0] + "\n" + "gi-\nấy báo có"
            text = "\n".join(lines)
        truth[i] = kind != 3
        rows.append((i, f"s{i // 5}.pdf", i % 5, True if i % 2 else None, text, 0))
    rows += [(500, "s99.pdf", 1, True, None, 0), (501, "s99.pdf", 2, True, "", 0), (502, None, None, None, SENTENCES[0] * 800, 0), (60, *rows[60][1:])]
    return spark.createDataFrame(rows, "page_id long, source string, page int, ocr_used boolean, text string, words int"), truth


def test_noise_is_found_and_mended(spark):
    df, truth = pages(spark)
    model = scans.fit(df)
    got = {r.page_id: r for r in scans.repair_scans(df, model).collect()}
    wrong = [i for i, t in truth.items() if got[i].noisy != t]
    assert len(wrong) <= 2, wrong
    assert not any(got[i].noisy for i in range(60)) and not got[500].noisy and not got[501].noisy and got[500].repaired is None
    mended = got[61].repaired
    assert "kbớp" not in mended and "rihóm" not in mended
    assert "Công báo" not in got[60].repaired and "\n" not in got[60].repaired.strip()


def test_training_data_round_trip():
    rng = random.Random(3)
    for word in ("nghiêm", "điều", "khoản", "Ban"):
        for _ in range(60):
            bad, ops = scans.corrupt(word, rng)
            undone = "".join("" if op == "D" else op[1:] if op[0] == "R" else (op[1:] if op[0] == "I" else "") + c for c, op in zip(bad, ops[:-1], strict=True))
            assert undone + (ops[-1][1:] if ops[-1][0] == "I" else "") == word


def test_lost_letters_and_many_edits(spark):
    df, _ = pages(spark)
    model = scans.fit(df)
    for good, bad in (("chuyển sang nhóm theo dõi", "chuyển sang nhó theo dõi"), ("khách hàng liên quan không", "khách hàng liê quan không"), ("nhóm khách hàng liên quan", "rihórn khách hàng liên quan")):
        assert scans.fix_words(bad, model) == (good, 1)
    assert scans.fix_words("chuyển sang zzzz theo dõi", model) == ("chuyển sang zzzz theo dõi", 0)
    assert [t for _, t in scans.readings("rihóm", model)][0] == "nhóm"


def test_readings_are_those_of_an_exhaustive_search():
    """The guided walk finds every attested word that the editor's operations reach."""
    from itertools import product

    words = frozenset({"ban", "bar", "an", "ab", "nba", "bn", "b", "aban"})
    model = scans.Model(words, known=words, ordered=sorted(words), labels={"a": ["K", "Ro", "D"], "n": ["K", "Rr", "Ib"], "b": ["K", "D"], "$": ["K", "In"]})
    for word in ("ban", "abn", "na", "bo", "aab"):
        most, want = max(2, 2 * len(word) // 3), {}
        for ops in product(*[model.labels.get(c, ["K"]) for c in word], model.labels["$"]):
            for more in product((False, True), repeat=len(word)):  # an insertion and then any other operation on the same character
                text, n = "", 0
                for c, op, also in zip(word, ops, more, strict=False):
                    for x in (["Ib"] if also and c == "n" and op != "Ib" else []) + [op]:
                        n += x != "K"
                        text += "" if x == "D" else x[1:] if x[0] == "R" else x[1:] + c if x[0] == "I" and x == op else x[1:] if x[0] == "I" else c
                if ops[-1] == "In":
                    text, n = text + "n", n + 1
                if text in words and text != word and 0 < n <= most:
                    want[text] = min(want.get(text, 9), n)
        assert {t: round(c / scans.EDIT) for c, t in scans.readings(word, model)} == want


def test_empty(spark):
    df, _ = pages(spark)
    empty = df.limit(0)
    assert scans.repair_scans(empty, scans.fit(empty)).count() == 0
    assert scans.repair_page("trang 5", 5, scans.Model())[0] == "trang 5"


def test_furniture_is_removed_at_any_depth(spark):
    df, _ = pages(spark)
    rng = random.Random(2)
    rows = []
    for i in range(600, 640):
        lines = wrap(" ".join(rng.sample(SENTENCES, 5))).split("\n")
        lines.insert(len(lines) // 2 if i % 4 == 0 else len(lines), f"– {i - 599} –")
        rows.append((i, f"t{i // 5}.pdf", i - 599, True, "\n".join(lines), 0))
    model = scans.fit(df.unionByName(spark.createDataFrame(rows, df.schema)))
    for i, _, page, _, text, _ in rows:
        repaired, _, _, furniture = scans.repair_page(text, page, model)
        assert f"– {page} –" not in repaired and furniture == 1, i
    assert scans.repair_page("– 2 –\n" * 3 + rows[1][4], 2, model)[3] == 4
    content = wrap(" ".join(SENTENCES)).replace("21 phần", "21\nphần")
    assert scans.repair_page(content, 3, model)[3] == 0
