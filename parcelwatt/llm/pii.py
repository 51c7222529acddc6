r"""Personal data by fixed patterns and by bootstrapped contexts, in DataFrame functions only.

Base spans of four kinds are found by fixed patterns (leftmost, not overlapping within a kind; a match that fails its check is
dropped). They seed a bootstrap: every token with a digit or an at sign is an instance, neighbouring tokens of digits without
letters are one (unless punctuation ends the first, or a base span touches only one of them), and the words around it are its
patterns (two words before; one before and one after; two after). A pattern's confidence in a kind is the share of its distinct
instances that are held to be of that kind, shrunk by ``prior`` unbelieving instances; an instance's score is the noisy-or of
its patterns. Both are scored in turn over the pattern-instance graph until nothing changes. A pattern counts with ``support``
instances believed so far: seeds, and those that a pattern of confidence ``confidence`` has shown; so what was found supports
further patterns. Instances that no base span touches become spans of a kind where such a pattern shows them.

Graph rows are distinct (pattern, instance) pairs over distinct texts, so neither copies of a text nor a frequent pattern
make one task's work grow: all sums are partial aggregates, and joins are left to adaptive skew handling.

Positions are code points, the end exclusive. Very long texts are taken whole, in work that grows with the number of their tokens times
its square root; of spans that begin at one place the kind listed first comes first. Defined results: a null text is an empty one; repeated rows give one result each;
null ids are kept; an empty table gives no rows; ``redacted`` keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from parcelwatt.llm.common import cut, free_name

KINDS = ("email", "ip", "card", "phone")
# Each says what the plain pattern says. Possessive repeats and the look behind only spare attempts that must fail: a match
# begins where the last one ended or at the head of a run, since within a run the tail cannot match where the head does not.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    parts = F.split(F.reverse(digits), "")
    doubled = F.transform(parts, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """``items`` in blocks of about the square root of their number."""
    def cut_up(a):
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        return F.when(F.size(a) == 0, F.slice(F.array(a), 1, 0)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.greatest(width, F.lit(1))), lambda at: F.slice(a, at, width)))

    return _bound(items, cut_up)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of the whole numbers, 0 or more, what ``join`` (a sum, a maximum) makes of those before it; 0 for the first.

    Block by block, so that no array longer than a block grows by appending: the work is the number times its square root.
    """
    def plain(a):
        def step(state, v):
            return F.struct(join(state["at"], v).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

        return F.aggregate(a, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda state: state["out"])

    def by_block(blocks):
        heads = plain(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda so_far, v: join(so_far, v))))
        return _bound(heads, lambda h: F.flatten(F.transform(blocks, lambda b, i: F.transform(plain(b), lambda v: join(v, F.get(h, i))))))

    return _bound(_blocks(values), by_block)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _matches(text: Column, pattern: str, hint: str, context: int = 0) -> Column:
    """array of (start, stop, value[, before, after]: up to ``context`` words in lower case) of all matches: the texts between matches, from a split at the same pattern, give the positions."""
    fields = "start:int,stop:int,value:string" + (",before:array<string>,after:array<string>" if context else "")
    kind = f"array<struct<{fields}>>"

    def placed(values, between):
        # the text before a match and the match itself, by turns; the running sum at a match is its start
        ends = F.transform(values, lambda v, i: F.length(F.get(between, i)) + F.length(v))
        arrays = [values.alias("value"), _running(ends, _sum).alias("begin"), F.transform(F.slice(between, 1, F.size(values)), F.length).alias("gap")]
        if context:
            last = lambda g: _bound(_words(g), lambda w: F.slice(w, F.greatest(F.size(w) - context + 1, F.lit(1)), F.lit(context)))
            arrays.append(F.transform(F.slice(between, 1, F.size(values)), last).alias("before"))
            arrays.append(F.transform(F.slice(between, 2, F.size(values)), lambda g: F.slice(_words(g), 1, context)).alias("after"))
        return F.transform(F.arrays_zip(*arrays), lambda m: F.struct(
            (m["begin"] + m["gap"]).alias("start"), (m["begin"] + m["gap"] + F.length(m["value"])).alias("stop"), m["value"].alias("value"),
            *([m["before"].alias("before"), m["after"].alias("after")] if context else [])))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = _bound(found, lambda values: _bound(F.split(text, pattern, -1), lambda between: placed(values, between)))
    any_match = text.contains(hint) & text.rlike(pattern) if hint else text.rlike(pattern)
    return F.when(any_match, spans.cast(kind)).otherwise(F.array().cast(kind))


def _span_type(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of (start, stop, value) of its base spans."""
    def checked(kind: str):
        return lambda s: _valid(kind, s["value"])

    return {k: F.filter(_matches(text, PATTERNS[k], HINTS[k]), checked(k)) for k in KINDS}


def listed(spans: Column) -> Column:
    """kind:start:end of sorted (start, kind, stop) spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest, base (sorted spans) and tokens of every row; no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("digest"), *(v.alias(k) for k, v in base_spans(F.col("t")).items()), _matches(F.col("t"), TOKEN, "", 2).alias("tokens"))
    base = F.array_sort(F.concat(*(_span_type(F.col(k), i) for i, k in enumerate(KINDS))))
    return read.select("doc_id", "digest", base.alias("base"), "tokens")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _joined(scanned: DataFrame) -> DataFrame:
    """digest, tokens of every distinct text that has some: neighbouring tokens of digits as one; touch is the first base span on it."""
    once = scanned.where(F.size("tokens") > 0).select("digest", "base", "tokens").dropDuplicates(["digest"])

    def touched(blocks):
        """The tokens with the first base span on each, looked for in the blocks of base spans that reach it."""
        reaching = lambda t, held: F.filter(held, lambda b: (b["start"] < t["stop"]) & (b["stop"] > t["start"]))
        touch = lambda t: F.get(F.flatten(F.transform(reaching(t, blocks), lambda b: reaching(t, b["held"]))), F.lit(0))
        return F.transform("tokens", lambda t: F.struct(*(t[c].alias(c) for c in ("start", "stop", "value", "before", "after")), touch(t).alias("touch")))

    reach = F.transform(_blocks(F.col("base")), lambda held: F.struct(
        F.array_min(held["start"]).alias("start"), F.array_max(held["stop"]).alias("stop"), held.alias("held")))
    marked = once.select("digest", _bound(reach, touched).alias("tokens"))
    token = lambda i: F.element_at("tokens", i)
    number = lambda t: ~t["value"].rlike(r"[\p{L}@]")

    def begins(i):
        t, p = token(i), token(F.greatest(i - 1, F.lit(1)))
        return (i == 1) | (F.size(t["before"]) > 0) | ~number(t) | ~number(p) | p["value"].rlike(r"[.,;:!?]$") | ~t["touch"].eqNullSafe(p["touch"])

    # positions of the first tokens as a column of their own, so that they are found once a text
    heads = marked.select("digest", "tokens", F.filter(F.sequence(F.lit(1), F.size("tokens")), begins).alias("heads"))

    def united(h, k):
        end = F.coalesce(F.try_element_at("heads", k + 2) - 1, F.size("tokens"))
        value = F.array_join(F.transform(F.sequence(h, end), lambda i: token(i)["value"]), " ")
        return F.struct(token(h)["start"].alias("start"), token(end)["stop"].alias("stop"), value.alias("value"),
                        token(h)["before"].alias("before"), token(end)["after"].alias("after"), token(h)["touch"].alias("touch"))

    return heads.select("digest", F.transform("heads", united).alias("tokens"))


def mentions(scanned: DataFrame) -> DataFrame:
    """One row per instance of every distinct text: digest, start, stop, value, kind (null if no base span touches it), patterns."""
    # every text here has tokens; a plain explode would ask for that again below the projections, with the heads found anew for each token
    tokens = _joined(scanned).select("digest", F.explode_outer("tokens").alias("m"))
    before, after = F.col("m.before"), F.col("m.after")
    at = lambda words, i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit("|"))
    patterns = F.array(
        F.concat_ws(" ", at(before, -2), at(before, -1), F.lit("_")),
        F.concat_ws(" ", at(before, -1), F.lit("_"), at(after, 1)),
        F.concat_ws(" ", F.lit("_"), at(after, 1), at(after, 2)))
    # lexical patterns only: two words of context, neither of them an instance or the edge of the text
    patterns = F.filter(patterns, lambda p: ~p.rlike(r"[0-9@]|(^| )\|( |$)"))
    return tokens.select("digest", F.col("m.start").alias("start"), F.col("m.stop").alias("stop"), F.col("m.value").alias("value"),
                         F.col("m.touch.kind").alias("kind"), patterns.alias("patterns"))


def discover(scanned: DataFrame, rounds: int | None = None, support: int = 5, confidence: float = 0.8, prior: float = 1.0) -> DataFrame:
    """digest, start, kind, stop of the instances that confident patterns show to be personal data; ``rounds`` limits the growth."""
    found, every = cut(mentions(scanned)), range(len(KINDS))
    # an instance is a value; it seeds a kind if most of its mentions are base spans of that kind
    shares = [F.avg(F.when(F.col("kind") == i, 1.0).otherwise(0.0)).alias(f"s{i}") for i in every]
    seeds = found.groupBy(F.xxhash64("value").alias("instance")).agg(*shares)
    seeds = cut(seeds.select("instance", *(F.when(F.col(f"s{i}") > 0.5, 1.0).otherwise(0.0).alias(f"s{i}") for i in every)))
    graph = found.select(F.explode("patterns").alias("pattern"), F.xxhash64("value").alias("instance")).distinct()
    # a pattern of too few instances can never count, whatever they turn out to be
    usable = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= support)
    graph = cut(graph.join(usable, "pattern").select("pattern", "instance"))
    # only instances that a pattern of the graph holds can give or take belief
    seeds = cut(seeds.join(graph.select("instance").distinct(), "instance", "left_semi"))
    score = seeds.select("*", *(F.col(f"s{i}").alias(f"b{i}") for i in every))  # s: score, b: 1 if believed
    done, last = 0, None
    while True:
        belief = [F.when(F.sum(f"b{i}") >= support, F.sum(f"s{i}") / (F.count(F.lit(1)) + prior)).otherwise(0.0).alias(f"c{i}") for i in every]
        patterns = cut(graph.join(score, "instance").groupBy("pattern").agg(*belief).where(F.greatest(*(f"c{i}" for i in every)) > 0))
        # confidences never fall from round to round: the end is where none becomes sure and none rises by over 0.001
        old = [F.lit(0.0)] * len(KINDS) if last is None else [F.coalesce(f"o{i}", F.lit(0.0)) for i in every]
        moved = patterns if last is None else patterns.join(last, "pattern", "left")
        rises = [(F.col(f"c{i}") - o > 1e-3) | (F.col(f"c{i}") >= confidence) & (o < confidence) for i, o in zip(every, old)]
        still = moved.where(reduce(or_, rises)).isEmpty()
        done += 1
        if still or done == rounds:
            break
        last = patterns.select("pattern", *(F.col(f"c{i}").alias(f"o{i}") for i in every))
        doubt = [F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col(f"c{i}")))).alias(f"l{i}") for i in every]
        shown = [F.max(F.when(F.col(f"c{i}") >= confidence, 1.0).otherwise(0.0)).alias(f"m{i}") for i in every]
        judged = graph.join(patterns, "pattern").groupBy("instance").agg(*doubt, *shown)
        score = cut(seeds.join(judged, "instance", "left").select(
            "instance", *(F.greatest(f"s{i}", F.coalesce(1 - F.exp(f"l{i}"), F.lit(0.0))).alias(f"s{i}") for i in every),
            *(F.greatest(f"s{i}", F.coalesce(f"m{i}", F.lit(0.0))).alias(f"b{i}") for i in every)))
    # only patterns that are confident by themselves discover
    sure = patterns.where(F.greatest(*(f"c{i}" for i in range(len(KINDS)))) >= confidence)
    best = F.array_max(F.array(*(F.struct(F.col(f"c{i}").alias("c"), F.lit(-i).alias("k")) for i in range(len(KINDS)))))
    open_mentions = found.where("kind IS NULL").select("digest", "start", "stop", F.explode("patterns").alias("pattern"))
    return open_mentions.join(sure.withColumn("best", best), "pattern").groupBy("digest", "start", "stop").agg((-F.max("best")["k"]).alias("kind")).select(
        "digest", "start", "kind", "stop")


def _extra(scanned: DataFrame, **options) -> DataFrame:
    """digest, more: the discovered spans of each distinct text that has any."""
    return cut(discover(scanned, **options).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("more")))


def spans(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind number, stop, sorted) for every row of ``docs`` (doc_id, text)."""
    scanned = cut(_scan(docs))
    extra = _extra(scanned, **options)
    joined = scanned.select("doc_id", "digest", "base").join(extra, "digest", "left")
    return joined.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans (sorted) replaced by the kind of its first span in angle brackets."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def runs(held, reached):
        """(start, kind, stop) of the runs; reached: the furthest stop before each span."""
        heads = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (F.get(held, i)["start"] >= F.get(reached, i)))
        furthest = F.array_max(held["stop"])
        return _bound(heads, lambda h: F.transform(h, lambda at, i: F.struct(
            F.get(held, at)["start"].alias("start"), F.get(held, at)["kind"].alias("kind"),
            F.when(i + 1 < F.size(h), F.get(reached, F.get(h, i + 1))).otherwise(furthest).alias("stop"))))

    def replaced(block, begin):
        """One block of runs with the text before each from ``begin`` on, cut from a slice of the text that ends with the block."""
        def cut_from(piece):
            after = lambda i: F.when(i == 0, begin).otherwise(F.get(block, F.greatest(i - 1, F.lit(0)))["stop"])
            return F.array_join(F.transform(block, lambda s, i: F.concat(
                F.substring(piece, after(i) - begin + 1, s["start"] - after(i)), F.element_at(names, s["kind"] + 1))), "")

        return _bound(F.substring(text, begin + 1, F.get(block, F.size(block) - 1)["stop"] - begin), cut_from)

    def masked(blocks):
        ended = lambda i: F.get(F.get(blocks, i), F.size(F.get(blocks, i)) - 1)["stop"]
        parts = F.transform(blocks, lambda b, i: replaced(b, F.when(i == 0, F.lit(0)).otherwise(ended(F.greatest(i - 1, F.lit(0))))))
        return F.concat(F.array_join(parts, ""), F.substring(text, ended(F.size(blocks) - 1) + 1, F.length(text)))

    whole = _bound(spans, lambda held: _bound(_running(held["stop"], _greater), lambda reached: _bound(_blocks(runs(held, reached)), masked)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redacted(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs`` with all found spans of ``text`` masked; a null text stays null."""
    scanned = cut(_scan(docs))
    extra = _extra(scanned, **options)
    digest, base, more = (free_name(docs, n) for n in ("_digest", "_base", "_more"))
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = base_spans(text)
    sorted_base = F.array_sort(F.concat(*(_span_type(kinds[k], i) for i, k in enumerate(KINDS))))
    marked = docs.withColumn(digest, F.sha2(text, 256))
    bound = 100_000
    few = extra.limit(bound + 1).count() <= bound
    right = extra.select(F.col("digest").alias(digest), F.col("more").alias(more))
    joined = marked.join(F.broadcast(right) if few else right, digest, "left").withColumn(base, sorted_base)
    every = F.when(F.col(more).isNull(), F.col(base)).otherwise(F.array_sort(F.concat(F.col(base), F.col(more))))
    return joined.withColumn(base, every).withColumn("text", mask(F.col("text"), F.col(base))).select(*docs.columns)
