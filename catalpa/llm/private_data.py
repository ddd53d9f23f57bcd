"""Personal data by bootstrapped contextual extraction.

Base spans (email, ip, card, phone) come from fixed patterns and are the seed entities. A seed's lexical patterns are what stands
before it: the word, the two words, and the last one to TOKENS tokens (runs of letters or digits, single signs), so that a cue glued to the
seed or glued to other text has patterns too; what stands after it is not used. Patterns and instances (seeds, and other tokens of a kind's shape) form a weighted graph that Spark scores in turns:
a pattern's confidence is the share of its instances' weight held by reliable instances of its kind, times the share of all
its occurrences in the corpus that an instance follows; an instance is as reliable as its patterns jointly make it (of patterns with the same
last token, which hold one another, the best counts), seeds stay at 1. Patterns that end above MIN_PATTERN with MIN_SEEDS different seeds or more discover instances above MIN_INSTANCE.

Only DataFrame operations are used. Defined cases: null text is empty; no span gives empty strings and counts of 0; offsets are code
points, the end exclusive; a discovered span that overlaps another is dropped (base spans stay). Counts are of base spans.
Null ids, repeated ids and repeated rows are searched each for itself; a text may hold any number of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalpa.llm.common import col
from catalpa.session import checkpoint

KINDS = ("email", "ip", "card", "phone")
#: A leading look-behind or \G (the end of the match before) starts a match where a run of its first characters starts, as
#: the leftmost match does, so that long runs are tried once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens of a kind's shape that the base patterns leave out.
SHAPES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?:(?<![0-9A-Fa-f:])|\G)(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,18}+",
    "phone": r"\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){1,4}",
}
BLANKS = r"[\x20\x09-\x0D]+"
#: Letters of scripts written without blanks (South-East Asian, Chinese, Japanese) are tokens of their own.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
LETTER = rf"[A-Za-z[\p{{L}}\p{{M}}&&[^{UNSPACED}]]]"
#: A token keeps the blank after it.
TOKEN = rf"(?:{LETTER}++|\p{{N}}++|[^\x20\x09-\x0D])\x20?"
TOKENS = 3
#: A context is looked for in so many characters before a place; where they don't hold it whole, in more, at last in all.
WINDOWS = (48, 512)
TURNS = 3
MIN_SEEDS = 5
MIN_PATTERN = 0.7
MIN_INSTANCE = 0.7
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; df should come from a checkpoint."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def sound(kind: str, match: Column) -> Column:
    """What a base match must pass besides its pattern."""
    if kind == "ip":
        trimmed = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(trimmed, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        number = digits(match)
        return F.length(number).between(16, 19) & F.call_function("luhn_check", number)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def passing(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: sound(kind, s["value"]))


SPAN = "array<struct<kind:int,start:int,stop:int,value:string>>"
SECTION = 256


def located(text: Column, pattern: str, kind: int, hits: Column) -> Column:
    """array<struct<kind, start, stop, value>> of all matches, from the lengths of the matches and of what lies between.

    Places are summed up section by section, so that the work grows with the number of matches, not with its square.
    """
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    pairs = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("value"))
    sections = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / SECTION).cast("int")), lambda i: F.slice(pairs, i * SECTION + 1, F.lit(SECTION)))
    lengths = F.transform(sections, lambda s: F.aggregate(s, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["value"])))
    begins = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        stop = begin + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), stop.alias("stop"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    def spans(section: Column) -> Column:
        return F.aggregate(section["pairs"], F.struct(section["begin"].alias("at"), F.array().cast(SPAN).alias("found")), step)["found"]

    placed = F.arrays_zip(sections.alias("pairs"), F.slice(begins, 1, F.size(sections)).alias("begin"))
    return F.flatten(F.transform(placed, spans))


def matches(text: Column, name: str, patterns: dict[str, str], gate: Column) -> Column:
    """All located matches of a kind; texts that fail the gate aren't searched."""
    empty = F.array().cast(SPAN)
    pattern = patterns[name]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(gate & text.rlike(pattern), located(text, pattern, KINDS.index(name), hits)).otherwise(empty)


def spell(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def folded(text: Column) -> Column:
    """Lower-cased, the same for a text and for its beginning: the form of sigma depends on what follows."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(folded(text), BLANKS, " "), F.lit(TOKEN), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(folded(text), BLANKS), "")


def left_of(text: Column, start: Column) -> Column:
    """The end of the text before a place, with the last words and tokens whole."""
    glued = ~F.substring(text, start, F.lit(1)).rlike(BLANKS)
    found = None
    for n in WINDOWS:
        window = F.substring(text, F.greatest(F.lit(1), start - n + 1), F.least(start, F.lit(n)))
        words = window.rlike(r"[\x20\x09-\x0D][^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]")
        enough = (start <= n) | words | (glued & (F.size(tokens_of(window)) > TOKENS))
        found = F.when(enough, window) if found is None else found.when(enough, window)
    return found.otherwise(F.substring(text, F.lit(1), start))


def before(text: Column, start: Column) -> Column:
    """(cue, patterns) of a place: the last token before it, and the patterns that end there (t: of tokens, w: of words).

    Nothing for a place at the start of the text or inside a token.
    """
    inside = F.substring(text, start, F.lit(2)).rlike(rf"^(?:{LETTER}{{2}}|\p{{N}}{{2}})$")
    left = F.array(F.when((start > 0) & ~inside, left_of(text, start)).otherwise(""))
    parts = F.transform(left, lambda x: F.struct(tokens_of(x).alias("t"), F.when(x.rlike(BLANKS + "$"), words_of(x)).otherwise(F.array().cast("array<string>")).alias("w")))

    def last(parts: Column, n: int) -> Column:
        return F.slice(parts, -n, n)

    def made(x: Column) -> Column:
        by_tokens = [F.when(F.size(x["t"]) >= n, F.concat(F.lit("t"), F.array_join(last(x["t"], n), ""))) for n in range(1, TOKENS + 1)]
        by_words = [F.when(F.size(x["w"]) >= n, F.concat(F.lit("w"), F.array_join(last(x["w"], n), " "))) for n in (1, 2)]
        return F.struct(F.array_join(last(x["t"], 1), "").alias("cue"), F.array_compact(F.array(*by_tokens, *by_words)).alias("patterns"))

    return F.transform(parts, made)[0]


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, base, seen) of every row; seen: base spans and candidates with their patterns. mark tells texts apart."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).alias("doc_id"), text.alias("text"))
    has_digit, has_at = F.col("text").rlike("[0-9]"), F.contains(F.col("text"), F.lit("@"))
    gates = {"email": has_at, "ip": has_digit, "card": has_digit, "phone": F.contains(F.col("text"), F.lit("+")) & has_digit}
    rows = rows.withColumn("base", F.concat(*[passing(k, matches(F.col("text"), k, PATTERNS, gates[k])) for k in KINDS]))
    wider = {"email": has_at | F.contains(F.lower("text"), F.lit("at]")) | F.contains(F.lower("text"), F.lit("at)")), "ip": F.contains(F.col("text"), F.lit(":")) & has_digit, "card": has_digit, "phone": has_digit}
    other = F.concat(*[matches(F.col("text"), k, SHAPES, wider[k]) for k in KINDS])
    other = F.filter(other, lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    rows = rows.withColumn("other", other)
    seen = F.concat(
        F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lower(s["value"]).alias("value"), F.lit(True).alias("seed"), before(F.col("text"), s["start"]).alias("left"))),
        F.transform("other", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lower(s["value"]).alias("value"), F.lit(False).alias("seed"), before(F.col("text"), s["start"]).alias("left"))),
    )
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), F.transform("base", lambda s: s.dropFields("value")).alias("base"), seen.alias("seen"))


def occurrences(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(pattern, total): how often each wanted pattern stands before further text anywhere in the corpus.

    wanted: (pattern, cue). Tokens are put together only where the last of them is some pattern's cue.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    names, cues = small(wanted.select("pattern")), small(wanted.select("cue").distinct())
    none = F.lit(None).cast("string")

    def places(parts: Column, names: list[str]) -> DataFrame:
        """Each part that another follows, and those before it."""
        shifted = [F.concat(F.array(*[none] * n), F.col("p")).alias(name) if n else F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))).alias(name) for n, name in enumerate(names)]
        return docs.select(parts.alias("p")).select(F.inline(F.arrays_zip(*shifted)))

    near = places(tokens_of(text), ["cue", *[f"t{n}" for n in range(1, TOKENS)]]).join(cues, "cue", "left_semi")
    runs, run = [], F.col("cue")
    for n in range(TOKENS):
        run = run if n == 0 else F.concat(F.col(f"t{n}"), run)
        runs.append(F.concat(F.lit("t"), run))
    by_tokens = near.select(F.explode(F.array_compact(F.array(*runs))).alias("pattern"))
    two = F.concat(F.lit("w"), F.col("w2"), F.lit(" "), F.col("w1"))
    by_words = places(words_of(text), ["w1", "w2"]).select(F.explode(F.array_compact(F.array(F.concat(F.lit("w"), F.col("w1")), two))).alias("pattern"))
    return by_tokens.unionByName(by_words).join(names, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total"))


def reliable(edges: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confidence of each (pattern, kind) and reliability of each (value, kind), after TURNS turns over the graph."""
    instances = edges.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("trust"))
    patterns = None
    for _ in range(TURNS):
        held = edges.join(instances, ["kind", "value"])
        mass = held.groupBy("pattern", "kind").agg(F.sum(F.log1p("c") * F.col("trust")).alias("good"), F.sum("c").alias("met"), F.count_if("seed").alias("seeds"))
        every = edges.groupBy("pattern").agg(F.sum(F.log1p("c")).alias("weight"))
        joined = mass.join(every, "pattern").join(totals, "pattern").where(F.col("seeds") >= MIN_SEEDS)
        cover = F.least(F.lit(1.0), F.col("met") / F.col("total"))
        patterns = joined.select("pattern", "kind", (F.col("good") / F.col("weight") * cover).alias("confidence"))
        best = edges.join(patterns, ["pattern", "kind"], "left").groupBy("kind", "value", "cue").agg(F.max("seed").alias("seed"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
        votes = best.groupBy("kind", "value").agg(F.max("seed").alias("seed"), F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))).alias("doubt"))
        instances = votes.select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("trust"))
        patterns, instances = checkpoint(patterns), checkpoint(instances)
    return patterns, instances


def discover(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame | None:
    """(doc_id, mark, kind, start, stop) of further identifiers, or None where no pattern is frequent enough to have any."""
    each = found.select("doc_id", "mark", F.explode("seen").alias("s")).select("doc_id", "mark", "s.*")
    each = each.select("doc_id", "mark", "kind", "start", "stop", "value", "seed", "left.cue", F.explode("left.patterns").alias("pattern"))
    edges = each.groupBy("pattern", "cue", "kind", "value").agg(F.count("*").alias("c"), F.max("seed").alias("seed"))
    strong = edges.where("seed").groupBy("pattern", "cue", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS)
    wanted = checkpoint(strong.select("pattern", "cue").distinct())
    if wanted.isEmpty():
        return None
    edges = checkpoint(edges.join(small(wanted.select("pattern")), "pattern", "left_semi"))
    if edges.where("NOT seed").isEmpty():
        return None
    totals = checkpoint(occurrences(docs, text_col, wanted))
    patterns, instances = reliable(edges, totals)
    good = patterns.where(F.col("confidence") >= MIN_PATTERN).select("pattern", "kind")
    new = each.where("NOT seed").join(good, ["pattern", "kind"], "left_semi")
    return new.join(instances.where(F.col("trust") >= MIN_INSTANCE), ["kind", "value"], "left_semi").select("doc_id", "mark", "kind", "start", "stop").distinct()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, base, spans): base spans and all spans of every row, by kind, then start."""
    found = checkpoint(scan(docs, id_col, text_col))
    new = discover(docs, found, text_col)
    if new is None:
        return found.select("doc_id", "mark", "base", F.col("base").alias("spans"))
    grouped = new.groupBy(F.col("doc_id").alias("i"), F.col("mark").alias("m")).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind"))).alias("new"))
    apart = F.aggregate("new", F.array().cast("array<struct<start:int,stop:int,kind:int>>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] > s["start"]), acc).otherwise(F.concat(acc, F.array(s))))
    grouped = grouped.select("i", "m", F.transform(apart, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("new"))
    joined = found.join(grouped, F.expr("doc_id <=> i AND mark = m"), "left")
    return joined.select("doc_id", "mark", "base", F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new"))).alias("spans"))


def base_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, base, spans) with the base spans alone: one pass over the texts, nothing is learned or kept."""
    return scan(docs, id_col, text_col).select("doc_id", "mark", "base", F.col("base").alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; a span that begins inside another is masked with it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        plain = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        free = s["start"] >= acc["at"]
        parts = F.when(free, F.concat(acc["parts"], F.array(plain, F.element_at(names, s["kind"] + 1)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), parts.alias("parts"))

    done = F.aggregate(ordered, begin, step)
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def counted(kind: int):
    return lambda n, k: n + (k == kind).cast("long")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.aggregate(kinds, F.lit(0).cast("long"), counted(i)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))
