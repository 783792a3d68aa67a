"""Variant spellings of names typed by people (problem 2).

Strings are read into an ordered list of plain tokens: look-alike characters, typing
codes, run-together words, titles, commas and aliases in brackets are undone.
Strings with the same tokens form a spelling group.  A group written in several ways
stands for a name of its own; every other group is linked to the one name that it
resembles most.  Candidates come from suffix blocking: what is indexed are token suffixes of at least MIN_TOKENS tokens and
MIN_LETTERS letters, of the name, its rotations and their left parts; of each such part the shortest suffix long enough
(a longer one gives a block within that block), once as it is and once with the token before its last left out,
for a token that is mistyped.  Names of two tokens or with all but one end mistyped meet by one end and the other's initial.  Blocks are
refined by the kind of entity and by the numbers in the name, which parts no pair that could be linked.  A suffix
that is still common is not discarded, since that loses pairs which differ in all rarer ones: its block is dealt
over tasks.  Candidates are compared by
longest-common-subsequence ratio after initials and abbreviations are expanded along
the name they are compared with.  Links form stars, whose components are the names.

Defined cases: null strings and other entity types take no part; an empty or blank
string links to nothing; equal scores of two names link to neither; repeated rows
count once; an alias in brackets that stands behind many names (a title) is none.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.confusables import Rewriter, representatives
from lamina.llm.syllables import TONES, is_syllable, strip_marks
from lamina.session import cut_lineage

THRESHOLD, TYPO, MARGIN, OWN_FORMS = 0.72, 0.82, 0.01, 3
BLOCK_LIMIT, MIN_TOKENS, MIN_LETTERS = 2000, 2, 4

# Forms of address and degrees before a person's name.
_TITLES = re.compile(r"^(?:(?:ông|bà|anh|chị|đ/c|đồng chí|mr|mrs|ms|dr|gs|pgs|ts|ths|ks|cn|bs|luật sư|ls|cử nhân|thạc sĩ|tiến sĩ|giáo sư)(?:\.|(?=\s))\s*)+", re.IGNORECASE)
_TELEX = {"aa": "â", "ee": "ê", "oo": "ô", "aw": "ă", "ow": "ơ", "uw": "ư", "dd": "đ"}
_TONE_KEYS = dict(zip("fsrxj", TONES[:1] + TONES[1:2] + TONES[3:4] + TONES[2:3] + TONES[4:5], strict=True))


@lru_cache(maxsize=1)
def _unify() -> Rewriter:
    return Rewriter(representatives({}))


def from_telex(token: str) -> str:
    """The token with keyboard codes resolved, if that makes a syllable of what is none; else as it is."""
    low = token.lower()
    if not low.isascii() or not low.isalpha() or not (low[-1] in _TONE_KEYS or any(code in low for code in _TELEX)):
        return token
    tone = ""
    body = low
    if len(body) > 1 and body[-1] in _TONE_KEYS:
        tone, body = _TONE_KEYS[body[-1]], body[:-1]
    for code, letter in _TELEX.items():
        body = body.replace(code, letter)
    body = body.replace("ưo", "ươ")
    if body == low or not is_syllable(body):
        return token
    return body  # the tone is left out: names are compared without marks


def _spaced(text: str) -> str:
    """Run-together capitalised syllables, parted."""
    parts = "".join(f" {c}" if i and c.isupper() and text[i - 1].islower() else c for i, c in enumerate(text)).split()
    return " ".join(parts) if len(parts) >= 3 and all(is_syllable(p) for p in parts) else text


def tokens_of(part: str) -> list[str]:
    """Plain lower-case tokens of one part of a name; an initial or abbreviation keeps a full stop at its end."""
    part = part.strip(" .;:-–\t")
    if part.count(",") == 1:
        last, first = part.split(",")
        part = f"{first.strip()} {last.strip()}"
    part = _TITLES.sub("", part)
    if " " not in part:
        part = _spaced(part)
    raw = re.findall(r"[^\s.,;()\[\]\"“”]+\.?", part)
    out = []
    for i, token in enumerate(raw):
        dotted = token.endswith(".")
        core = token.rstrip(".")
        if not core:
            continue
        plain = strip_marks(from_telex(core)).lower()
        letters = [c for c in core if c.isalpha()]
        short = len(letters) == 1 and len(raw) > 1 and core.isalpha()
        shout = 2 <= len(core) <= 5 and core.isupper() and len(raw) > 1 and not part.isupper() and not is_syllable(core)
        vowelless = len(core) == 3 and core.isalpha() and len(raw) > 1 and not is_syllable(plain) and not re.search("[aeiou]", plain)
        out.append(plain + "." if (dotted and i + 1 < len(raw)) or short or shout or vowelless else plain)
    return out


def read_name(name: str) -> tuple[list[str], list[list[str]]]:
    """Tokens of the name proper, and of each alias that the string itself gives."""
    text = re.sub(r"\s+", " ", _unify().rewrite(name)).strip()
    aliases = []
    m = re.fullmatch(r"(.+?)\s*[(\[]([^()\[\]]+)[)\]]\s*", text)
    if m:
        text = m.group(1)
        aliases.append(m.group(2))
    elif re.search(r"\s[–—-]\s", text):
        text, *more = re.split(r"\s[–—-]\s", text)
        aliases += more
    return tokens_of(text), [a for a in map(tokens_of, aliases) if a]


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel recurrence."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def _alike(a: str, b: str) -> float:
    """Token likeness; letters in another order are a slip of the fingers."""
    return 1.0 if sorted(a) == sorted(b) else ratio(a, b)


def _prefix_run(token: str, name: tuple[str, ...], at: int) -> int:
    """How many name tokens from `at` on the abbreviation covers, each by a prefix; 0 if it fits none."""
    best = 0

    def walk(pos: int, i: int) -> None:
        nonlocal best
        if pos == len(token):
            best = max(best, i - at)
            return
        if i >= len(name):
            return
        limit = min(len(name[i]), len(token) - pos)
        for n in range(1, limit + 1):
            if name[i][n - 1] != token[pos + n - 1]:
                break
            walk(pos + n, i + 1)

    walk(0, at)
    return best


def _expanded(tokens: tuple[str, ...], name: tuple[str, ...]) -> tuple[str, float] | None:
    """The tokens with each abbreviation replaced by what it stands for in the name, in order, and a
    discount for what was guessed; None where an abbreviation fits nowhere."""
    out, at, guessed = [], 0, 0
    for k, token in enumerate(tokens):
        if not token.endswith("."):
            out.append(token)
            spot = next((i for i in range(at, len(name)) if name[i] == token), None)
            at = (spot if spot is not None and spot - at <= 2 else at) + 1
            continue
        core = token[:-1].replace("-", "")
        fits = [(abs(i - at), i, n) for i in range(max(0, at - 1), len(name)) if (n := _prefix_run(core, name, i))]
        if not fits:
            if len(core) < 3:
                return None
            out.append(core)
            at += 1
            continue
        _, i, n = min(fits)
        out.extend(name[i : i + n])
        guessed += n
        at = i + n
    return "".join(out), guessed / max(1, len(name))


def turns(tokens: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The tokens as they stand, and with the first moved to the end or the last to the front."""
    if len(tokens) < 3:
        return [tokens]
    return [tokens, tokens[1:] + tokens[:1], tokens[-1:] + tokens[:-1]]


def numbers_of(tokens: tuple[str, ...]) -> list[str]:
    return sorted(re.findall(r"\d+", " ".join(tokens)))


def resemblance(tokens: tuple[str, ...], name: tuple[str, ...]) -> float:
    """How well the tokens fit the name, 0 to 1: the LCS ratio of the expanded tokens and the name, the best
    over the rotations.  Numbers must agree; every token written out must stand in the name, typos aside.
    Tokens that all stand in the name in its order are a shortened form and score above any typo."""
    if numbers_of(tokens) != numbers_of(name):
        return 0.0
    target, best = "".join(name), 0.0
    for j, turned in enumerate(turns(tokens)):
        got = _expanded(turned, name)
        if got is None or got[1] > 0.8:
            continue
        text, guessed = got
        full = [t for t in turned if not t.endswith(".")]
        if not full or any(max(_alike(t, n) for n in name) < 0.55 for t in full):
            continue
        if not guessed and len(turned) == len(name) and any(_alike(t, n) < 0.5 for t, n in zip(turned, name, strict=True)):
            continue
        score = ratio(text, target)
        if len(turned) >= 2 and all(t in name for t in full) and _in_order(turned, name):
            score = 0.8 + 0.2 * score
        elif guessed == 0 and score < TYPO:
            continue
        best = max(best, score - 0.06 * guessed - 0.02 * (j > 0))
    return best


def _in_order(tokens: tuple[str, ...], name: tuple[str, ...]) -> bool:
    at = 0
    for t in tokens:
        if t.endswith("."):
            continue
        spot = next((i for i in range(at, len(name)) if name[i] == t), None)
        if spot is None:
            return False
        at = spot + 1
    return tokens[0][0] == name[0][0]


def _suffix(tokens: tuple[str, ...], skip: bool = False) -> str | None:
    """The shortest suffix that is long enough and has no abbreviation; with `skip` the token before the last left out."""
    held: list[str] = []
    for i, token in enumerate(reversed(tokens)):
        if skip and i == 1:
            continue
        if token.endswith("."):
            return None
        held.insert(0, token)
        if len(held) >= MIN_TOKENS and sum(map(len, held)) >= MIN_LETTERS:
            return " ".join(held) + ("~" if skip else "")
    return None


def block_keys(tokens: tuple[str, ...]) -> list[str]:
    """Keys of the suffix index, each under the numbers that the name holds: these must agree (resemblance)."""
    keys = set()
    for turned in turns(tokens):
        plain = [t.rstrip(".") for t in turned]
        for end in range(1, len(turned) + 1):
            keys |= {_suffix(turned[:end]), _suffix(turned[:end], True)}
        keys.add(f"{plain[-1]}|{plain[0][:1]}")
        keys.add(f"{plain[0]}|{plain[-1][:1]}|")
    numbers = ",".join(numbers_of(tokens))
    return sorted(f"{numbers}:{k}" for k in keys - {None})


_PLAIN = re.compile("(?:ngh|ng|nh|gh|gi|kh|ph|th|tr|ch|qu|[bcdghklmnpqrstvx])?(?:uye|uya|ieu|yeu|uou|oai|oay|uay|uoi|[aeiouy]{1,2})(?:ng|nh|ch|[cmnptiyou])?")


def is_clean(tokens: tuple[str, ...]) -> bool:
    """A name written out: three tokens or more, each a plain syllable or a number."""
    return len(tokens) >= 3 and all(t.isdigit() or _PLAIN.fullmatch(t) for t in tokens)


READ = T.StructType().add("tokens", T.ArrayType(T.StringType())).add("aliases", T.ArrayType(T.ArrayType(T.StringType())))
KEYS = T.ArrayType(T.StringType())


@F.pandas_udf(READ)
def _read_batch(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_name(n) for n in names], columns=["tokens", "aliases"])


@F.pandas_udf(KEYS)
def _keys_batch(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: block_keys(tuple(t)))


@F.pandas_udf(T.BooleanType())
def _clean_batch(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: is_clean(tuple(t)))


@F.pandas_udf(T.DoubleType())
def _resemblance_batch(tokens: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([resemblance(tuple(a.split(" ")), tuple(b.split(" "))) for a, b in zip(tokens, name, strict=True)], dtype="float64")


def spellings(names: DataFrame) -> DataFrame:
    """Distinct strings with their spelling group: name, kind, n, tokens, aliases, g.

    `names` has name and kind, a row per occurrence; counting is done before anything else."""
    counted = names.filter(F.col("name").isNotNull()).groupBy("name", "kind").agg(F.count("*").alias("n"))
    one = counted.groupBy("name").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.sum("n").alias("n"))
    read = one.withColumn("__r", _read_batch("name")).select("name", "kind", "n", "__r.tokens", "__r.aliases")
    return read.withColumn("g", F.concat_ws(" ", F.col("kind"), F.array_sort("tokens")))


def _groups(strings: DataFrame) -> DataFrame:
    aliases = strings.select("kind", F.explode("aliases").alias("a")).select(F.concat_ws(" ", "kind", F.array_sort("a")).alias("g"), F.lit(True).alias("is_alias")).distinct()
    groups = strings.filter(F.size("tokens") > 0).groupBy("g").agg(
        F.first("kind").alias("kind"), F.count("*").alias("forms"), F.sum("n").alias("support"), F.max_by("tokens", F.struct("n", "name")).alias("tokens")
    )
    groups = groups.join(aliases, "g", "left").withColumn("is_alias", F.coalesce("is_alias", F.lit(False)))
    return groups.withColumn("clean", _clean_batch("tokens")).withColumn("short", F.exists("tokens", lambda t: t.endswith(".")))


def _candidates(groups: DataFrame) -> DataFrame:
    """Pairs (g, h) that share a block; the asking side of a block over BLOCK_LIMIT is dealt over several tasks, which meet all its names."""
    keyed = groups.select("*", F.explode(_keys_batch("tokens")).alias("__b"))
    parts = F.ceil(F.col("count") / F.lit(BLOCK_LIMIT)).cast("int").alias("__parts")
    large = keyed.groupBy("kind", "__b").count().filter(F.col("count") > BLOCK_LIMIT).select("kind", "__b", parts)
    keyed = keyed.join(large, ["kind", "__b"], "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    own = (F.col("forms") >= OWN_FORMS) & F.col("clean")
    asks = keyed.filter(~own & ~F.col("is_alias")).withColumn("__part", F.pmod(F.xxhash64("g"), F.col("__parts")).cast("int"))
    names = keyed.filter(F.col("clean") & ~F.col("is_alias")).select(
        F.col("g").alias("h"), F.col("kind").alias("__hk"), F.col("__b").alias("__hb"), F.col("tokens").alias("h_tokens"),
        F.col("support").alias("h_support"), F.col("forms").alias("h_forms"),
        F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__hp"),
    )
    rank = lambda f, s, g: F.struct(F.least(F.col(f), F.lit(OWN_FORMS)), F.col(s), F.col(g))
    longer = F.size("h_tokens") != F.size("tokens")
    fair = F.col("short") | (F.size("h_tokens") > F.size("tokens")) | (rank("h_forms", "h_support", "h") > rank("forms", "support", "g"))
    fair &= F.col("short") | longer | (F.col("h_support") >= 2 * F.col("support"))
    pairs = asks.join(names, (F.col("kind") == F.col("__hk")) & (F.col("__b") == F.col("__hb")) & (F.col("__part") == F.col("__hp")) & (F.col("g") != F.col("h")))
    return pairs.filter(fair).select("g", "h", F.array_join("tokens", " ").alias("a"), F.array_join("h_tokens", " ").alias("b"), "h_support").distinct()


def name_links(groups: DataFrame) -> DataFrame:
    """The name each lesser spelling group is linked to: g, h, score.  Two names that fit alike, with like support, take none."""
    scored = _candidates(groups).withColumn("score", _resemblance_batch("a", "b")).filter(F.col("score") >= THRESHOLD)
    order = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("h_support"), "h")
    near = Window.partitionBy("g")
    top = scored.withColumn("__best", F.max("score").over(near)).filter(F.col("score") > F.col("__best") - MARGIN)
    top = top.withColumn("__most", F.max("h_support").over(near)).filter(F.col("h_support") * 3 >= F.col("__most"))
    return top.withColumn("__n", F.count("*").over(near)).withColumn("__r", F.row_number().over(order)).filter("__n = 1 AND __r = 1").select("g", "h", "score")


def _components(nodes: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """(g, component) by repeated minimum over neighbours; lineage is cut every round.  Stars and alias chains end in a few rounds."""
    both = cut_lineage(edges.select("g", "h").unionByName(edges.select(F.col("h").alias("g"), F.col("g").alias("h"))).distinct())
    labels = cut_lineage(nodes.select("g", F.col("g").alias("component")))
    for _ in range(most):
        heard = both.join(labels, "g").groupBy(F.col("h").alias("g")).agg(F.min("component").alias("__new"))
        new = cut_lineage(labels.join(heard, "g", "left").select("g", F.least("component", F.coalesce("__new", "component")).alias("component"), (F.col("__new") < F.col("component")).alias("__moved")))
        moved = new.filter("__moved").limit(1).count()
        labels = new.select("g", "component")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def link_variants(names: DataFrame) -> DataFrame:
    """One row per distinct string: name, kind, n, component."""
    strings = cut_lineage(spellings(names))
    groups = cut_lineage(_groups(strings))
    links = cut_lineage(name_links(groups))
    aliases = strings.select("g", "kind", F.explode("aliases").alias("a")).select("g", F.concat_ws(" ", "kind", F.array_sort("a")).alias("alias")).distinct()
    roots = aliases.join(links.select("g", F.col("h").alias("__root")), "g", "left").withColumn("__root", F.coalesce("__root", "g"))
    titles = roots.groupBy("alias").agg(F.countDistinct("__root").alias("__n")).filter("__n > 2").select("alias")
    true = aliases.join(titles, "alias", "left_anti").select("g", F.col("alias").alias("h"))
    nodes = strings.select("g").unionByName(true.select(F.col("h").alias("g"))).distinct()
    labels = _components(nodes, links.select("g", "h").unionByName(true))
    return strings.join(labels, "g").select("name", "kind", "n", "component")


def variant_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of strings of one component, name_1 < name_2 by code point: what the result asks for."""
    a = linked.select("component", F.col("name").alias("name_1"))
    b = linked.select("component", F.col("name").alias("name_2"))
    return a.join(b, "component").filter("name_1 < name_2").select("name_1", "name_2")
