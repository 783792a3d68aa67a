from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import split


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,Đế́", max_size=900), st.integers(20, 120), st.integers(0, 15))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    cut = split.cuts(text, limit, overlap)
    assert cut == sorted(set(cut)) and (cut == []) == (len(text) <= limit)
    edges = [0, *cut, len(text)]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        start = max(0, a - overlap) if i else 0
        assert 0 < b - start <= limit or not text


def test_boundaries_are_kept():
    text = ("Một câu vừa phải ở đây. " * 12 + "\n\n") * 8
    cut = split.cuts(text, 400, 40)
    assert cut and all(text[c - 1] in " \n" for c in cut) and sum(text[c - 1] == "\n" for c in cut) >= len(cut) // 2
    assert split.cuts("x" * 2500, 1000, 100) and split.cuts("", 10, 1) == []


def test_table(spark):
    limits = spark.createDataFrame([("s", 50, 10), ("t", 1000, 0)], "strategy string, max_chars int, overlap_chars int")
    text = "câu một hai ba bốn. " * 20
    rows = [("a", "s", text, 1, 4, 9), ("b", "t", text, 1, 4, 9), ("c", None, text, 1, 4, 9), ("d", "s", None, 1, 4, 9), ("e", "s", "", None, None, 9), ("f", "s", "ngắn", None, 3, 9), ("a", "s", text, 1, 4, 9), ("g", "s", "y" * 100_000, None, None, 9)]
    df = spark.createDataFrame(rows, "chunk_id string, strategy string, text string, page_start int, page_end int, piece_no int")
    got = split.split_chunks(df, limits).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_id, []).append(r)
    assert "d" not in by and len(by["b"]) == len(by["c"]) == len(by["e"]) == len(by["f"]) == 1 and by["e"][0].piece == ""
    a = sorted({(r.piece_no, r.piece, r.char_start, r.char_end, r.piece_page_start, r.piece_page_end) for r in by["a"]})
    assert len(by["a"]) == 2 * len(a) and all(len(p) <= 50 for _, p, *_ in a)
    whole = "".join(p if n == 1 else p[10:] for n, p, *_ in a)
    assert whole == text and a[0][4] == 1 and a[-1][5] == 4
    for x, y in zip(a, a[1:]):
        assert y[1][:10] == text[x[3] - 10 : x[3]]
    assert by["f"][0].piece_page_start == 3 and by["g"][0].n_pieces > 1000
    assert split.split_chunks(df.limit(0), limits).count() == 0


def test_no_overlap_begins_with_a_mark():
    import unicodedata

    text = unicodedata.normalize("NFD", "điềuếộ" * 60)
    for limit, overlap in ((50, 7), (40, 13), (33, 5)):
        at = split.cuts(text, limit, overlap)
        assert at and not any(unicodedata.combining(text[p]) or unicodedata.combining(text[p - overlap]) for p in at)
        ends = [0, *at, len(text)]
        assert all(b - a + (overlap if a else 0) <= limit for a, b in zip(ends, ends[1:], strict=False))
    assert split.cuts("\u0301" * 100, 30, 5)  # nothing but marks is cut all the same
