"""Template residue, filler and error-page text (problem 9).

A first look at the single words of every line passes on those that may be no prose; it is made where the text lies, so
nothing else travels.  These lines are dropped into a fixed-depth prefix tree (token count, first DEPTH tokens, last token, digits
masked).  What lies in a leaf is one message template where its lines are alike: the positions at which they differ
become wildcards.  Each template is classified once and the verdict is propagated to every line that matches it;
in a leaf of unlike lines, and for a line that does not match, the line is a template of its own.  Unresolved slots inside
ordinary records are found separately, by a grammar of slot delimiters and contents.  A document is residue if it holds a slot
or a filler line, or if messages make up most of its text without furniture.

The classifier is a logistic model of words, pairs of neighbours and shape with four classes: message, filler, furniture
and prose.  It is fitted here, on the labelled rows of residue_rows and on lines of at most SAMPLE_DOCUMENTS long documents
(SAMPLE_LINES lines, PROSE_ROWS of them at first) as prose.  A long document is no message, so sampled lines that the
first fit takes for one are added as prose and the model is fitted again.

Defined cases: null, empty and blank texts are no residue; texts of any length are looked at whole; without long
documents the labelled rows alone decide, and what is unlike all of them is prose; an empty table gives no rows; a
null key is a document of its own; other columns play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import residue_rows
from lamina.session import cut_lineage

DEPTH, ALIKE = 4, 0.5
SAMPLE_DOCUMENTS, SAMPLE_LINES, PROSE_ROWS, LONG = 1500, 20_000, 4000, 1000
SURE, POSSIBLE = 0.75, 0.05
WILD = "<*>"
CLASSES = ("message", "filler", "furniture", "prose")

# Words that field names and fill-in instructions begin with.
_FIELD = (
    "Số|Tên|Ngày|Chức danh|Ghi|Nhập|Điền|Căn cứ|Địa chỉ|Họ|Nội dung|Đơn vị|Lãi suất|Mã|Tiêu đề|Chọn|Chèn|Thêm|Cập nhật|Bổ sung|Nơi|Người|Loại|Phụ lục|Trích yếu|Chữ ký|Thời|Lý do|Kính gửi|"
    "Your|Name|Insert|Enter|Add|Date|Address|Title|Customer|Company|Amount|Type|Click|Fill|Replace|Signature|Legal|Effective|Contract|Position|Text|Choose|Select|Branch|Loan|Rate|TBD|TODO|TBC"
)
_SNAKE = "[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+"
_CAPS = "(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z]{5,})"
_PHRASE = f"(?:(?:{_FIELD})(?![\\p{{L}}])[^\\[\\]{{}}<>«»\\n]*+|{_SNAKE}|{_CAPS}|TBD|TODO|TBC|FIXME)"
#: One alternative for each kind of delimiter.  What stands inside may be of any length, within its line.
SLOTS = (
    "\\{\\{[^{}\\n]*+\\}\\}", "\\{[%#][^}\\n]++(?<=[%#])\\}", "<%[^%\\n]*+%>", "<<[^<>\\n]++>>", "\\[\\[[^\\[\\]\\n]++\\]\\]",
    "\\$\\{[^{}\\n]++\\}", f"\\$(?:{_SNAKE}|[A-Z]{{4,}}|[a-z]{{4,}})\\$?(?![\\p{{L}}])", "%[A-Z][A-Z_0-9]{2,}%", "%\\([a-z_0-9]+\\)[sd]",
    "__[A-Z][A-Z0-9_]*__", "#[A-Z][A-Z_0-9]{3,}#", ":[a-z]+(?:_[a-z]+)+:", "@Model\\.[a-z_A-Z]+", "@@[A-Za-z_]+@@", "&lt;[^&\\n]++&gt;",
    f"\\[\\s*{_PHRASE}\\s*\\]", f"\\{{\\s*(?:{_PHRASE}|[a-z]{{4,}})\\s*\\}}", f"<\\s*{_PHRASE}\\s*>", f"«\\s*{_PHRASE}\\s*»",
    "\\[\\s*(?:●|•|_+|\\?+|x{2,}|X{2,}|\\.{3,}| ?)\\s*\\]", "\\{\\s*(?:[0-9]{1,2}(?::[A-Z][0-9]?)?)?\\s*\\}", "(?<![\\p{L}\\d])(?:XX/XX/|[xX]{2}/[xX]{2}/|dd/mm/yyyy|DD/MM/YYYY)", "(?<![\\p{L}\\d])20XX(?![\\p{L}\\d])",
)
#: The look-ahead keeps the engine from trying every alternative at every letter.
SLOT = "(?=[{\\[<$%_#:@&«])(?:" + "|".join(s for s in SLOTS if not s.startswith("(?<!")) + ")"
DATE_SLOT = "|".join(s for s in SLOTS if s.startswith("(?<!"))


def mask(line: str) -> str:
    """The line in lower case, spaces run together, digits masked."""
    return re.sub(r"\d+", "#", re.sub(r"[\s\xa0]+", " ", line).strip().lower())


_TOKEN = re.compile(r"[^\W\d_]+|#|<\*>|[^\w\s]")


def features(line: str) -> list[str]:
    """Words, pairs of neighbours, first and last word, repetition and number of words of a masked line or template."""
    words = _TOKEN.findall(line)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    letters = [w for w in words if w[0].isalpha()]
    shape = [f"=n{min(len(words), 12)}", f"=d{len(set(letters)) < 0.75 * len(letters)}", "^" + words[0] if words else "^", "$" + words[-1] if words else "$"]
    runs = [f"=r{len(w)}" for w in letters if len(set(w)) == 1 and len(w) > 1]
    return list(dict.fromkeys([*words, *pairs, *shape, *runs]))


class Classifier:
    """Logistic regression over string features; features it was not fitted on play no part."""

    def __init__(self, rows: Iterable[tuple[str, int]], epochs: int = 10, rate: float = 0.5, seed: int = 1) -> None:
        data = [(features(line), label) for line, label in rows]
        self.place: dict[str, int] = {}
        for names, _ in data:
            for name in names:
                self.place.setdefault(name, len(self.place))
        self.weights = np.zeros((len(self.place), len(CLASSES)))
        squares = np.full_like(self.weights, 1e-8)
        known = [(np.array([self.place[n] for n in names]), label) for names, label in data]
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(known)):
                at, label = known[i]
                slope = self._shares(at)
                slope[label] -= 1
                slope /= np.sqrt(len(at))
                squares[at] += slope * slope
                self.weights[at] -= rate * slope / np.sqrt(squares[at])

    def _shares(self, at: np.ndarray) -> np.ndarray:
        z = self.weights[at].sum(axis=0) / np.sqrt(max(1, len(at)))
        e = np.exp(z - z.max())
        return e / e.sum()

    def verdict(self, line: str) -> str:
        """The class of a masked line.  It is residue where message and filler together reach SURE; a line of which more than
        a third of the words is unknown is prose."""
        words = _TOKEN.findall(line)
        if not words or 3 * sum(w in self.place for w in words) < 2 * len(words):
            return CLASSES[-1]
        at = [p for n in features(line) if (p := self.place.get(n)) is not None]
        shares = self._shares(np.array(at, dtype=int))
        if shares[0] + shares[1] >= SURE:
            return CLASSES[int(shares[1] > shares[0])]
        return CLASSES[2] if shares[2] >= shares[3] else CLASSES[3]


_STRIP = str.maketrans(dict.fromkeys(".,;:!?()[]{}<>\"'“”‘’«»…|/\\=-–—*", " ") | {str(i): "#" for i in range(10)})


class _Scores(dict):
    """Weights of words; a word that is not known weighs nothing."""

    def __missing__(self, key: str) -> float:
        return 0.0


class FirstLook:
    """Logistic regression over single words: whether a line may be anything but prose."""

    def __init__(self, rows: Iterable[tuple[str, bool]], epochs: int = 10, rate: float = 0.5, seed: int = 2) -> None:
        data = [(["", *self.words(line)], float(label)) for line, label in rows]
        self.weights = _Scores()
        squares = dict.fromkeys({w for words, _ in data for w in words}, 1e-8)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                words, label = data[i]
                size = len(words) ** 0.5
                slope = (1 / (1 + math.exp(-sum(map(self.weights.__getitem__, words)) / size)) - label) / size
                for w in words:
                    squares[w] += slope * slope
                    self.weights[w] = self.weights[w] - rate * slope / squares[w] ** 0.5
        self.least = math.log(POSSIBLE / (1 - POSSIBLE))

    @staticmethod
    def words(line: str) -> list[str]:
        return line.lower().translate(_STRIP).split()

    def passes(self, line: str) -> bool:
        words = self.words(line)
        return (self.weights[""] + sum(map(self.weights.__getitem__, words))) >= self.least * (len(words) + 1) ** 0.5


def labelled() -> list[tuple[str, int]]:
    return [(mask(line), k) for k, text in enumerate((residue_rows.MESSAGE, residue_rows.FILLER, residue_rows.FURNITURE)) for line in text.strip().split("\n")]


@dataclass
class Model:
    look: FirstLook
    judge: Classifier

    def verdict(self, line: str) -> str:
        """Of a masked line."""
        return self.judge.verdict(line) if self.look.passes(line) else CLASSES[-1]


def train(prose: list[str]) -> Model:
    """Fitted on the labelled rows and a part of the masked prose lines; then again with those of the rest that it took for messages."""
    some = sorted(set(prose), key=lambda x: (zlib.crc32(x.encode()), x))
    base = labelled() * 4
    first = [(x, 3) for x in some[:PROSE_ROWS]]
    look = FirstLook([(x, k < 3) for x, k in [*base, *first]])
    judge = Classifier([*base, *first])
    wrong = [(x, 3) for x in some[PROSE_ROWS:] if look.passes(x) and judge.verdict(x) == "message"]
    return Model(look, Classifier([*base, *first, *wrong * 4]) if wrong else judge)


def fit(df: DataFrame, key: str, text: str) -> Model:
    """The model of a table of documents.  The driver gets the sampled lines only, those of the least hash of their key."""
    long = df.filter(F.length(text) >= LONG).select(F.col(key).alias("__id"), F.xxhash64(key).alias("__h"))
    chosen = long.orderBy("__h").limit(SAMPLE_DOCUMENTS).select("__id")
    few = df.join(F.broadcast(chosen), F.col(key).eqNullSafe(F.col("__id")), "left_semi").select(F.explode(F.split(text, "\n")).alias("__line"))
    rows = few.select("__line", F.xxhash64("__line").alias("__h")).orderBy("__h").limit(SAMPLE_LINES).select("__line").toPandas()
    return train([m for x in rows["__line"] if (m := mask(x))])


def template(lines: list[str]) -> tuple[str, float]:
    """What masked lines of one leaf have in common, wildcards elsewhere, and the share of their tokens that agree."""
    tokens = [x.split(" ") for x in lines]
    same = [t if all(other[i] == t for other in tokens[1:]) else WILD for i, t in enumerate(tokens[0])]
    return " ".join(same), sum(t != WILD for t in same) / len(same)


def matches(line: str, shape: str) -> bool:
    a, b = line.split(" "), shape.split(" ")
    return len(a) == len(b) and all(y in (x, WILD) for x, y in zip(a, b, strict=True))


def has_slot(text: str) -> Column:
    """Whether the text holds an unresolved slot; dates to be filled in are looked for only where XX or a mask of letters stands."""
    body = F.col(text)
    dated = (body.contains("XX") | body.contains("xx/") | F.lower(body).contains("dd/mm/")) & body.rlike(DATE_SLOT)
    return body.rlike(SLOT) | dated


def look_at(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """Documents that hold a slot or a line which may be no prose: __id, has_slot, __prose (the size of all other lines), and those lines
    masked with their sizes.  One scan of the texts; what is left is stored."""
    kind = dict(df.dtypes)[key]
    shared = df.sparkSession.sparkContext.broadcast(model.look)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passes = shared.value.passes
        for frame in batches:
            out = []
            for i, body, slot in zip(frame["__id"], frame["__text"], frame["has_slot"], strict=True):
                prose, lines, sizes = 0, [], []
                for line in body.split("\n"):
                    line = line.strip()
                    if not line:
                        continue
                    if passes(line):
                        lines.append(mask(line))
                        sizes.append(len(line))
                    else:
                        prose += len(line)
                if slot or lines:
                    out.append((i, slot, prose, lines, sizes))
            if out:
                yield pd.DataFrame(out, columns=["__id", "has_slot", "__prose", "__lines", "__sizes"])

    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("__id"), F.col(text).alias("__text"), has_slot(text).alias("has_slot"))
    return cut_lineage(rows.mapInPandas(look, f"__id {kind}, has_slot boolean, __prose long, __lines array<string>, __sizes array<int>"))


def lines_of(looked: DataFrame) -> DataFrame:
    """The lines of look_at: __id, __line, __size and the line's leaf in the prefix tree."""
    rows = looked.select("__id", F.explode(F.arrays_zip("__lines", "__sizes")).alias("z")).select("__id", F.col("z.__lines").alias("__line"), F.col("z.__sizes").alias("__size"))
    tokens = F.split("__line", " ")
    return rows.withColumn("__leaf", F.xxhash64(F.size(tokens), F.concat_ws(" ", F.slice(tokens, 1, DEPTH), F.element_at(tokens, -1))))


_MINED = T.StructType().add("template", T.StringType()).add("verdict", T.StringType())
MIXED = "mixed"


def mine_templates(lines: DataFrame, model: Model) -> DataFrame:
    """One row per leaf: __leaf, template, n_lines, verdict.

    A leaf's template comes from three of its lines, the least, the greatest and the one of the least hash; a leaf whose
    lines are unlike, or are judged differently, is mixed: its lines are judged one by one."""
    shared = lines.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_MINED)
    def judge(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        m, out = shared.value, []
        for x in zip(a, b, c, strict=True):
            some = list(dict.fromkeys(x))
            shape, alike = template(some)
            said = {m.verdict(line) for line in some}
            one = said.pop() if len(said) == 1 else MIXED
            out.append((shape, one if one == "prose" or alike >= ALIKE else MIXED))
        return pd.DataFrame(out, columns=["template", "verdict"])

    leaves = lines.groupBy("__leaf").agg(
        F.min("__line").alias("a"), F.max("__line").alias("b"), F.min_by("__line", F.xxhash64("__line")).alias("c"), F.count("*").alias("n_lines")
    )
    return leaves.select("__leaf", "n_lines", judge("a", "b", "c").alias("j")).select("__leaf", "n_lines", "j.*")


def judge_lines(lines: DataFrame, model: Model) -> DataFrame:
    """Lines with `verdict`: that of their template, or their own where they match none.

    The planner broadcasts the templates while they are under its size bound; beyond it the join is on leaf, and AQE
    splits a leaf that holds a large share of the lines, as both sides come as they are."""
    shared = lines.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def settle(line: pd.Series, shape: pd.Series, verdict: pd.Series) -> pd.Series:
        m = shared.value
        own: dict[str, str] = {}
        out = []
        for x, y, v in zip(line, shape, verdict, strict=True):
            if x is None or (v != MIXED and matches(x, y)):
                out.append(v)
                continue
            if x not in own:
                own[x] = m.verdict(x)
            out.append(own[x])
        return pd.Series(out, dtype=object)

    found = mine_templates(lines, model).filter("verdict <> 'prose'").select(F.col("__leaf").alias("__l"), "template", "verdict")
    met = lines.join(found, F.col("__leaf") == F.col("__l"), "left")
    odd = F.col("__l").isNotNull()
    said = settle(F.when(odd, F.col("__line")), F.when(odd, F.col("template")), F.when(odd, F.col("verdict")))
    return met.select("__id", "__size", F.when(odd, said).otherwise("prose").alias("verdict"))


def judge_documents(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per key that holds residue: key, has_slot, filler_lines, message_share."""
    model = model or fit(df, key, text)
    looked = look_at(df, key, text, model)
    marked = judge_lines(lines_of(looked), model)
    size = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("__size")).otherwise(0))
    per = marked.groupBy("__id").agg(size("message").alias("__message"), size("prose").alias("__more"), F.count_if(F.col("verdict") == "filler").alias("filler_lines"))
    docs = looked.groupBy("__id").agg(F.max("has_slot").alias("has_slot"), F.sum("__prose").alias("__prose"))
    out = docs.join(per.withColumnRenamed("__id", "__of"), F.col("__id").eqNullSafe(F.col("__of")), "left").fillna(0, ["__message", "__more", "filler_lines"])
    share = F.coalesce(F.try_divide(F.col("__message"), F.col("__message") + F.col("__more") + F.col("__prose")), F.lit(0.0))
    out = out.select(F.col("__id").alias(key), "has_slot", "filler_lines", share.alias("message_share"))
    return out.filter("has_slot OR filler_lines > 0 OR message_share >= 0.5")
