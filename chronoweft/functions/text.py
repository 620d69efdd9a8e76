"""Text functions on columns: tokens, rules, fillers, keywords, widths. All are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"

# Categories and patterns of text that must not be published.
GUARD_RULES: dict[str, tuple[str, ...]] = {
    "extreme-word": (
        "最[佳具优好高低先新]", "第[一1](?![0-9百千万亿])", "全[网球]第[一1]", "唯一", "顶[尖级]", "国家级", "世界级", "极致", "万能", "独家", "首[发选家创]", "销量冠军", "全网最[低高便宜贵]价?", "史无前例", "遥遥领先", "王牌", "领袖品牌",
    ),
    "diversion-wechat": ("微信", "威信", "薇信", "嶶信", "徾信", r"\b[Vv][Xx]\b", r"\bwx\b", r"\bv信", r"加\s*[Vv＋+]", "＋[Vv]", r"\+\s*[Vv]\b", r"\b加微\b", "^薇$|[^a-z]薇[^a-z]|^威$|[^a-z]威[^a-z]"),
    "diversion-phone": (r"\b1[3-9]\d{9}\b",),
    "diversion-qq": (r"\b[Qq][Qq]号?\b", r"扣扣\d+|企鹅\d+"),
    "diversion-external": (r"\b(?:抖音|快手|淘宝|某宝|拼多多|某多|京东|视频号|公众号|私域|加群)\b",),
    "diversion-url": (r"(?:https?://|www\.|\.com|\.cn|\.net)",),
    "diversion-qrcode": ("二维码",),
    "medical-claim": ("治[愈疗]", "根治", "特效", "祛[斑痘印疤]", "抗[衰老氧化]", "水光针", "热玛吉", "线雕", "溶脂", "医生同款", "三甲(?:推荐|医院)"),
    "wealth-bait": (r"年入[\d一二两三四五六七八九十百千万]+", r"月入[\d一二两三四五六七八九十百千万]+", r"日入[\d一二两三四五六七八九十百千万]+", "躺赚", "财富自由", "稳赚不赔", "零成本", "包[过赚]", "暴利"),
}
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"
#: Characters from the CJK radicals on, in which many patterns have a letter.
WIDE = "[\\u2e80-\\uffef]"
PUNCTUATION_RUN = r"([!！?？。.])\1{2,}"


def tokens(text: Column) -> Column:
    """Single CJK characters and runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{CJK}]|[a-z0-9]+"), F.lit(0))


def token_count(text: Column, language: Column) -> Column:
    """CJK characters and ASCII words for zh, words with apostrophes otherwise; 1 at least."""
    zh = F.regexp_count(text, F.lit(f"[{CJK}]")) + F.regexp_count(text, F.lit("[A-Za-z0-9]+"))
    return F.greatest(F.lit(1), F.when(language == "zh", zh).otherwise(F.regexp_count(text, F.lit("[A-Za-z0-9']+"))))


def infer_language(text: Column, declared: Column | None = None) -> Column:
    """The declared language, else zh where there is a CJK character, else en."""
    guess = F.when(text.rlike(f"[{CJK}]"), "zh").otherwise("en")
    return guess if declared is None else F.coalesce(F.when(declared != "", declared), guess)


def clipped(text: Column, limit: int = 42) -> Column:
    """White space as single spaces, and an ellipsis where the text is longer than limit."""
    compact = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(compact) <= limit, compact).otherwise(F.concat(F.rtrim(F.substring(compact, 1, max(1, limit - 1))), F.lit("...")))


def display_units(text: Column) -> Column:
    """Width in CJK characters: 1 for those, 0.3 for white space, 0.55 for anything else."""
    wide, blank = F.regexp_count(text, F.lit(f"[{CJK}]")), F.regexp_count(text, F.lit(r"\s"))
    return wide + blank * 0.3 + (F.length(text) - wide - blank) * 0.55


def fillers(text: Column, words: Sequence[str]) -> Column:
    """The words of the list that occur in the text as whole words, in the order of the list."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(rf"\b\Q{w}\E\b"), F.lit(w)) for w in words]))


def without_fillers(text: Column, words: Sequence[str]) -> Column:
    """Lower-case ASCII letters and digits of the text, fillers and everything else left out."""
    out = F.lower(text)
    for w in words:
        out = F.regexp_replace(out, rf"\b\Q{w}\E\b", " ")
    return F.regexp_replace(out, "[^a-z0-9]+", "")


def signal_score(text: Column, signals: Mapping[str, tuple[Sequence[str], float]], most: float = 1.0) -> Column:
    """Sum over signals of weight times matches, each at most 1.8 weights, all together at most `most`."""
    total = F.lit(0.0)
    for patterns, weight in signals.values():
        count = lambda some: sum((F.regexp_count(text, F.lit(f"(?i){p}")) for p in some), F.lit(0))
        wide = [p for p in patterns if needs_wide(p)]
        matches = count([p for p in patterns if p not in wide])
        if wide:
            matches = matches + F.when(~text.rlike(WIDE), 0).otherwise(count(wide))
        total = total + F.least(F.lit(weight) * matches, F.lit(weight * 1.8))
    return F.least(F.lit(most), total)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use's own functions on arrays name it.

    Spark may put an expression in the place of the column that holds it, also where a function on an array reads that column for each element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _joined_runs(chars: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: F.array_join(F.slice(chars, i, n), ""))


def all_ngrams(text: Column, n: Column | int) -> Column:
    """The n-grams of characters, by place; none if the text is shorter. The text is taken apart once, as a place in a string is found by reading up to it."""
    none = F.array().cast("array<string>")
    return bound(F.split(text, ""), lambda chars: F.when((F.size(chars) >= n) & (chars[0] != ""), _joined_runs(chars, n)).otherwise(none))


def character_ngrams(text: Column, n: int = 2) -> Column:
    """The distinct n-grams of characters; the text itself, if it is shorter."""
    return F.array_distinct(F.when(F.length(text) >= n, all_ngrams(text, n)).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>")))


def fixed(value: Column, digits: int) -> Column:
    """value (a double below 10**9) with so many places, 6 at most, as printf writes it in C: what the double holds exactly is rounded, a half to even.

    format_string rounds the shortest decimal that stands for the double, a half up, so 0.0078125 becomes 0.007813 there, not 0.007812.
    """
    scale = 10**digits
    v = F.abs(value.cast("double"))
    scaled = v * F.lit(float(scale))
    # What the product lost by rounding: the factor is split in halves whose products are exact.
    high = v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v)
    lost = (high * F.lit(float(scale)) - scaled) + (v - high) * F.lit(float(scale))
    below = F.floor(scaled)
    over = (scaled - below) - F.lit(0.5)
    up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (below % 2 == 1))))
    whole = below + F.when(up, 1).otherwise(0)
    return F.concat(F.when(value < 0, "-").otherwise(""), F.floor(whole / scale).cast("string"), F.lit("."), F.lpad((whole % scale).cast("string"), digits, "0"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""

    def share(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["a"], pair["b"]))
        return F.try_divide(both, F.size(pair["a"]) + F.size(pair["b"]) - both)

    return F.coalesce(bound(F.struct(a.alias("a"), b.alias("b")), share), F.lit(0.0))


def ordered_terms(text: Column, pattern: str = "[,;，；、\\n]+") -> Column:
    """Terms of a list in text, trimmed; of those that differ by case only the first."""
    parts = F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def top_terms(df: DataFrame, by: Sequence[str], text: str, limit: int, least_length: int = 3, stop: Sequence[str] = ()) -> DataFrame:
    """(by, rank, term, n): the most frequent ASCII words of each key; ties by the term."""
    from pyspark.sql import Window

    words = df.select(*by, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).filter(F.length("term") >= least_length)
    if stop:
        words = words.filter(~F.col("term").isin(*stop))
    counted = words.groupBy(*by, "term").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "term"))).filter(F.col("rank") <= limit)


def needs_wide(pattern: str) -> bool:
    """Whether a match of the pattern surely holds a character of WIDE: one stands in each alternative, outside classes and what may be left out. False where that isn't plain."""
    plain = re.sub(r"\[[^\]]*\]", "", re.sub(r"\\.", "", pattern))
    plain = re.sub(r"\(\?(?:[!=]|<[!=])[^()]*\)", "", plain)
    surely = lambda p: all(any("\u2e80" <= c <= "\uffef" for c in re.sub(r".(?:[?*]|\{[^}]*\})", "", part)) for part in p.split("|"))
    while group := re.search(r"\((?:\?:)?([^()?]*(?:[^(]\?[^()?]*)*)\)", plain):
        plain = plain[: group.start()] + ("\u4e00" if surely(group[1]) else "") + plain[group.end() :]
    return "(" not in plain and surely(plain)


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns occurs, in any case. Those that need a wide character are looked for only where there is one."""
    wide, other = [p for p in patterns if needs_wide(p)], [p for p in patterns if not needs_wide(p)]
    look = lambda some: text.rlike("(?i)" + "|".join(f"(?:{p})" for p in some))
    if not wide:
        return look(other)
    found = text.rlike(WIDE) & look(wide)
    return found | look(other) if other else found


def emoji_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit(EMOJI)) / F.greatest(F.length(text), F.lit(1))


def blocked(text: Column, rules: Mapping[str, Sequence[str]] = GUARD_RULES) -> Column:
    """Whether any rule matches."""
    return any_of(text, [p for patterns in rules.values() for p in patterns])


def gate(text: Column, rules: Mapping[str, Sequence[str]] = GUARD_RULES) -> Column:
    """blocked for a whole text with a match of any rule, review for one that is too long for a caption or mostly emoji, else ready."""
    hard = blocked(text, rules)
    soft = (F.length(text) > 800) | (emoji_share(text) > 0.3)
    return F.when(hard, "blocked").when(soft, "review").otherwise("ready")


def violations(df: DataFrame, by: Sequence[str], text: str, rules: Mapping[str, Sequence[str]] = GUARD_RULES, context: str = "body") -> DataFrame:
    """(by, level, category, matched): one row for each match of a rule, and for what the context does not allow (title or caption)."""
    column = F.col(text)
    row = lambda category: lambda m: F.struct(F.lit("hard").alias("level"), F.lit(category).alias("category"), m.alias("matched"))
    # One look for any pattern of a category spares most texts the single ones, and one for a wide character spares most texts those that need it.
    none = F.array().cast("array<struct<level:string,category:string,matched:string>>")
    each = lambda c, some: F.when(any_of(column, some), F.flatten(F.array(*[F.transform(F.regexp_extract_all(column, F.lit(f"(?i){p}"), F.lit(0)), row(c)) for p in some]))).otherwise(none)
    wide = {c: some for c, patterns in rules.items() if (some := [p for p in patterns if needs_wide(p)])}
    hits = [each(c, some) for c, patterns in rules.items() if (some := [p for p in patterns if not needs_wide(p)])]
    if wide:
        hits.append(F.when(column.rlike(WIDE), F.flatten(F.array(*[each(c, some) for c, some in wide.items()]))).otherwise(none))
    soft = lambda when, category, matched: F.when(when, F.struct(F.lit("soft").alias("level"), F.lit(category).alias("category"), matched.alias("matched")))
    more = []
    if context == "title":
        more += [soft(F.length(column) > 20, "title-too-long", F.concat(F.substring(column, 1, 25), F.lit("…"))), soft(column.rlike(PUNCTUATION_RUN), "punct-run", F.regexp_extract(column, PUNCTUATION_RUN, 0))]
    if context in ("title", "caption"):
        emoji = F.regexp_count(column, F.lit(EMOJI))
        more.append(soft(emoji_share(column) > 0.3, "emoji-spam", F.concat_ws("/", emoji, F.length(column))))
    if context == "caption":
        more.append(soft(F.length(column) > 800, "caption-too-long", F.concat(F.lit("len="), F.length(column))))
    parts = [*hits, F.array_compact(F.array(*more))] if more else hits
    return df.filter(column.isNotNull()).select(*by, F.inline(F.flatten(F.array(*parts))))
