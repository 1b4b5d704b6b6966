"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

High-recall generators propose spans of each kind: at every place where a number or a name may begin, one
span for each number of groups or labels that can follow, so proposals overlap within a kind and across
kinds. Boosted trees score a candidate by its format (digits, groups, separators, check digit, domain)
and its context (what stands before and after, whether more digits do, words such as "call" or
"version"). A candidate is kept from the probability that was calibrated for its kind on held-out
candidates. Spans that meet a strict base pattern always stay; of the others that overlap, the likelier.

The trees are trained with pyspark.ml on the candidates that the same generators propose in texts made by
SQL from fixed templates, alone, in a row and in lists, with digits drawn by a hash, TRAINING of them; a
candidate is right where it is just what the template put there. The trees are then one SQL expression,
evaluated inside each row: nothing is exploded or shuffled, and each step is linear in the text: arrays
are scanned in pieces of CHUNK, overlaps are settled by a sweep in the order of the starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import under_safe_names, written

#: The kinds in their order and the base patterns. Possessive forms of the contract's: they
#: match the same, in linear time and without recursion on long runs.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Where candidates begin, with the text that their forms are cut from and four characters of context, by generator.
STARTS = {
    "email": r"(?<![\p{L}0-9._%+-])(?=([\p{L}0-9._%+-]++(?:@|\x20?(?:\(at\)|\[at\]|(?<=\x20)at(?=\x20))\x20?)[\p{L}0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|(?<=\x20)dot(?=\x20))\x20?)[\p{L}0-9-]++){1,4}+[\s\S]{0,4}))",
    "ip": r"(?<![0-9.])(?=([0-9]{1,4}+(?:(?:\.|\[\.\])[0-9]{1,4}+){2,5}+[\s\S]{0,4}))",
    "number": r"(?<![0-9])(?=([+(]{0,2}[0-9]++(?:[\x20()./-]{1,3}+[0-9]++){0,5}+[\s\S]{0,4}))",
}
#: What a text must hold before a generator runs.
NEEDS = {"email": r"@|\(at\)|\[at\]| at ", "ip": r"[0-9](?:\.|\[\.\])[0-9]", "number": r"[0-9]{4}|[0-9][\x20()./-]{1,3}[0-9]"}
#: The forms of a generator's candidates: kind and pattern, by the number of groups.
FORMS = {
    "email": [("email", r"^([\p{L}0-9._%+-]++(?:@|\x20?(?:\(at\)|\[at\]|(?<=\x20)at(?=\x20))\x20?)[\p{L}0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|(?<=\x20)dot(?=\x20))\x20?)[\p{L}0-9-]++){N})".replace("N}", f"{n}}}")) for n in (1, 2, 3, 4)],
    "ip": [("ip", r"^([0-9]{1,4}+(?:(?:\.|\[\.\])[0-9]{1,4}+){N})".replace("N}", f"{n}}}")) for n in (2, 3, 4)],
    "number": [("phone", r"^([+(]{0,2}[0-9]++(?:[\x20()./-]{1,3}+[0-9]++){N})".replace("N}", f"{n}}}")) for n in range(6)] + [("card", r"^([0-9]++(?:[\x20.-][0-9]++){%d})" % n) for n in range(6)],
}
#: Digits that a candidate of a number kind has.
DIGITS = {"phone": (7, 15), "card": (13, 19)}
#: Bounds of the training: texts, trees, depth; share of look-alikes that a threshold may let through.
TRAINING, TREES, DEPTH, LET_THROUGH = 4000, 10, 5, 0.005
FEATURES = ("kind", "digits", "length", "groups", "longest", "shortest", "first", "second", "last", "plus", "parens", "unpaired", "luhn", "dots", "dashes", "spaces", "at_sign", "spelled", "domain", "octets", "letters", "good_word", "bad_word", "letter_before", "letter_after", "digit_before", "digit_after", "groups_before")
#: Elements that a scan goes through at once.
CHUNK = 128

_SPANS = "array<struct<start:int,end:int,hit:string>>"
_models: dict[str, tuple] = {}


def let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def scan(items: Column, state: Column, kind: str, step, emit) -> Column:
    """array<kind> of what emit(state, x) gives, where it is not null, over the items in order; step(state, x) is the next state.

    An aggregate copies its accumulator at each element, so none holds a long array: the states at the
    start of each CHUNK items are found first, then each chunk emits by itself. Items are a variable or a column.
    """
    none = F.array().cast(f"array<{kind}>")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))
    starts = lambda parts: F.aggregate(parts, F.array(state), lambda known, part: F.concat(known, F.array(F.aggregate(part, F.element_at(known, -1), step))))

    def told(acc: Column, x: Column) -> Column:
        out = let(emit(acc["s"], x), lambda e: F.when(e.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(e))))
        return F.struct(step(acc["s"], x).alias("s"), out.alias("out"))

    def of(part: Column, start: Column) -> Column:
        return F.when(part.isNotNull(), F.aggregate(part, F.struct(start.alias("s"), none.alias("out")), told, lambda a: a["out"])).otherwise(none)

    return F.when(F.size(items) > 0, let(parts, lambda p: F.flatten(F.zip_with(p, starts(p), of)))).otherwise(none)


def zipped(text: Column, pattern: str, group: int) -> Column:
    """(gap, hit) of the matches: the text from the one before, and a group; the last gap has no hit."""

    def pair(r: Column) -> Column:
        # a match of no width at the very start leaves no empty gap before it
        gaps = F.when(F.size(r["hits"]) == F.size(r["gaps"]), F.concat(F.array(F.lit("")), r["gaps"])).otherwise(r["gaps"])
        return F.zip_with(gaps, r["hits"], lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("hits")), pair)


def found(text: Column, pattern: str, needs: str) -> Column:
    """(start, end, hit) of the leftmost non-overlapping matches, in code points, end exclusive."""
    step = lambda at, x: at + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    emit = lambda at, x: F.when(x["hit"].isNotNull(), F.struct((at + F.length(x["gap"])).alias("start"), step(at, x).alias("end"), x["hit"].alias("hit")))
    spans = let(zipped(text, pattern, 0), lambda items: scan(items, F.lit(0), "struct<start:int,end:int,hit:string>", step, emit))
    return F.when(text.rlike(needs), spans).otherwise(F.array().cast(_SPANS))


def beginnings(text: Column, name: str) -> Column:
    """(start, hit, before) of the places where a generator's candidates begin; before: up to 20 characters."""

    start = lambda s, x: s["at"] + F.length(x["gap"])
    before = lambda s, x: F.right(F.concat(s["tail"], x["gap"]), F.lit(20))
    step = lambda s, x: F.struct(start(s, x).alias("at"), before(s, x).alias("tail"))
    emit = lambda s, x: F.when(x["hit"].isNotNull(), F.struct(start(s, x).alias("start"), x["hit"].alias("hit"), before(s, x).alias("before")))
    kind = "struct<start:int,hit:string,before:string>"
    places = let(zipped(text, STARTS[name], 1), lambda items: scan(items, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), kind, step, emit))
    return F.when(text.rlike(NEEDS[name]), places).otherwise(F.array().cast(f"array<{kind}>"))


def proposed(text: Column, finish, keep=None) -> Column:
    """finish(kind, start, end, features) of all candidates of all generators, those that `keep` accepts."""

    kind = "struct<start:int,hit:string,before:string,by:string>"
    of = lambda name: F.transform(beginnings(text, name), lambda p: F.struct(p["start"].alias("start"), p["hit"].alias("hit"), p["before"].alias("before"), F.lit(name).alias("by")))
    # most numbers are too short for any form
    places = F.filter(F.concat(*map(of, STARTS)), lambda p: (p["by"] != "number") | (F.length(digits_of(p["hit"])) >= DIGITS["phone"][0]))

    def at(place: Column) -> Column:
        forms = lambda name: F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract(place["hit"], p, 1).alias("hit")) for k, p in FORMS[name]])
        shapes = F.when(place["by"] == "email", forms("email")).when(place["by"] == "ip", forms("ip")).otherwise(forms("number"))

        def fits(c: Column) -> Column:
            enough = lambda n: F.when(c["kind"] == "phone", n.between(*DIGITS["phone"])).when(c["kind"] == "card", n.between(*DIGITS["card"])).otherwise(F.lit(True))
            return (c["hit"] != "") & let(F.length(digits_of(c["hit"])), enough)

        def scored(c: Column) -> Column:
            after = F.substring(place["hit"], F.length(c["hit"]) + 1, F.lit(4))
            return let(features(c["kind"], c["hit"], place["before"], after), lambda x: finish(c["kind"], place["start"], place["start"] + F.length(c["hit"]), x))

        out = F.transform(F.filter(shapes, fits), scored)
        return F.filter(out, keep) if keep else out

    return F.flatten(F.transform(places.cast(f"array<{kind}>"), at))


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 24 digits passes the check digit; false for others."""
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))).otherwise(value(i))
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + doubled(i))
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 24), total % 10 == 0).otherwise(False)


def octets(hit: Column) -> Column:
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))).between(1, 3), F.ltrim(p, F.lit("0"))).cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(hit, r"\."), small)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the strict patterns by kind; matches that fail their test are dropped."""
    tests = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: octets(s["hit"]),
        "card": lambda s: let(digits_of(s["hit"]), lambda d: F.length(d).between(16, 19) & luhn(d)),
        "phone": lambda s: F.length(digits_of(s["hit"])).between(8, 15),
    }
    needs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
    return {k: F.filter(found(text, BASE[k], needs[k]), tests[k]) for k in KINDS}


def features(kind: Column, hit: Column, before: Column, after: Column) -> Column:
    """array<double> in the order of FEATURES."""
    sizes_of = F.transform(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0)), F.length)
    return let(digits_of(hit), lambda digits: let(sizes_of, lambda sizes: measured(kind, hit, before, after, digits, sizes)))


def measured(kind: Column, hit: Column, before: Column, after: Column, digits: Column, sizes: Column) -> Column:
    count = lambda what: F.length(hit) - F.length(F.regexp_replace(hit, what, ""))
    values = {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), kind),
        "digits": F.length(digits),
        "length": F.length(hit),
        "groups": F.size(sizes),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)),
        "shortest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "first": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)),
        "second": F.coalesce(F.get(sizes, F.lit(1)), F.lit(0)),
        "last": F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0)),
        "plus": hit.startswith("+"),
        "parens": hit.rlike(r"\([0-9]+\)"),
        "unpaired": count(r"\(") != count(r"\)"),
        "luhn": luhn(digits),
        "dots": count(r"\."),
        "dashes": count("-"),
        "spaces": count(" "),
        "at_sign": hit.contains("@"),
        "spelled": hit.rlike(r"[(\[]at[)\]]|[(\[]dot[)\]]"),
        "domain": hit.rlike(r"(?i)[\p{L}0-9-](?:\.|[ (\[]*dot[ )\]]*)[\p{L}]{2,10}$"),
        "octets": (F.size(sizes) == 4) & hit.rlike(r"^[0-9.]+$") & octets(hit),
        "letters": count(r"\p{L}"),
        "good_word": before.rlike(r"(?i)\b(?:tel|phone|call|mobile|fax|card|visa|pay|mail|write|contact|reach|host|address|from|ip)\b[^\p{L}]*$"),
        "bad_word": before.rlike(r"(?i)\b(?:version|release|section|order|invoice|isbn|part|page|no|nr|build|chapter|year|id|v|rfc|ref)\b[^\p{L}]*$"),
        "letter_before": before.rlike(r"[\p{L}0-9_/=]$"),
        "letter_after": after.rlike(r"^[\p{L}0-9_/=]"),
        "digit_before": before.rlike(r"[0-9][\x20()./-]{0,3}$"),
        "digit_after": after.rlike(r"^[\x20()./-]{0,3}[0-9]"),
        "groups_before": F.size(F.regexp_extract_all(F.regexp_extract(before, r"([0-9\x20().+/-]*)$", 1), F.lit("[0-9]+"), F.lit(0))),
    }
    return F.array(*[F.coalesce(values[f].cast("double"), F.lit(0.0)) for f in FEATURES])


def made_texts(spark: SparkSession, n: int) -> DataFrame:
    """(text, planted array<struct<kind, start, end>>, held): n texts of the templates; # is a digit, ~ a letter of a domain name.

    Personal data stands alone, or up to nine times in a row or a list; look-alikes are not planted.
    """
    yes = {
        "card": ["################", "#### #### #### ####", "####-####-####-####", "#### ###### #####", "################", "#### #### #### ####"],
        "phone": ["+# (###) ###-####", "+## ### ### ####", "(###) ###-####", "###-###-####", "+##########", "### ### ####", "+## (0) ## #### ####", "###.###.####", "(###) ###-####", "###-###-####"],
        "email": ["~~~~.##@~~~~.~~~", "~~~@~~~~.com", "~~~~ at ~~~~~ dot com", "~~~ (at) ~~~~ (dot) org", "~~~[at]~~~~.net", "~~.~~~@~~~~.~~~~.com", "~~~~ (at) ~~~~.org"],
        "ip": ["1##.2#.1#.##", "1##.1##.1##.1##", "##.##.##.#", "10.#.#.1##", "1#[.]#[.]1##[.]##"],
    }
    no = ["########", "##########", "####################", "#############", "#### ####", "###########", "###.###.###", "####", "####-##-##", "##/##/####", "##.##.####", "####-####", "#.##", "## ##", "######-##", "#### ### ### ####", "#### ####-##-##", "### pages, ## of ####", "~~~~ at ~~~~", "~~ at ~~~~. ~~~", "@~~~~", "~~~~@~~~", "~~ at ~~~~~ and ~~", "#.#.#", "#.##.#", "##.#.##", "3##.4##.9##.1##", "#.#.#.#.#", "####.##.##", "9##.##.#.##", "#:##:##", "# ## # ## # ##"]
    plain = ["the ", "and ", "on ", "", ". ", "word ", "\n", "est, "]
    good = ["call ", "tel: ", "card ", "mail ", "contact: ", "from ", "reach me ", *plain, *plain]
    bad = ["version ", "order no. ", "isbn ", "build ", "page ", "section ", "id ", *plain, "v", "abc/", "x="]
    shapes = [(k, s, 1) for k, all_ in yes.items() for s in all_] + [("", s, 0) for s in no]
    each = max(1, n // len(shapes))
    pick = lambda of, salt: F.array(*map(F.lit, of))[F.pmod(F.xxhash64(F.lit(salt), "shape", "i"), F.lit(len(of))).cast("int")]
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("shape"), F.lit(y).alias("label")) for k, s, y in shapes])).alias("t")).select("t.*")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(each)))).withColumn("times", pick([1, 1, 2, 3, 6, 9], "n"))
    chars = F.filter(F.split("shape", ""), lambda c: c != "")
    draw = lambda t, j: F.pmod(F.xxhash64(F.lit("c"), F.col("shape"), F.col("i"), t, j), F.lit(10)).cast("int")
    filled = lambda t: F.array_join(F.transform(chars, lambda c, j: F.when(c == "#", draw(t, j).cast("string")).when(c == "~", F.substring(F.lit("aeinorstlm"), draw(t, j) + 1, F.lit(1))).otherwise(c)), "")
    rows = rows.withColumns({"items": F.transform(F.sequence(F.lit(1), F.col("times")), filled), "gap": pick([" ", ", ", "\n", "; ", " / ", " and "], "g"), "before": F.when(F.col("label") == 1, pick(good, "b")).otherwise(pick(bad, "b"))})
    rows = rows.withColumns({"at": F.length("before"), "wide": F.length("shape") + F.length("gap"), "text": F.concat("before", F.expr("array_join(items, gap)"), pick([" the", ".", "", ", ", "\n", "!!"], "a"))})
    span = lambda t: F.struct(F.col("kind"), (F.col("at") + (t - 1) * F.col("wide")).alias("start"), (F.col("at") + (t - 1) * F.col("wide") + F.length("shape")).alias("end"))
    planted = F.when(F.col("label") == 1, F.transform(F.sequence(F.lit(1), F.col("times")), span)).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    return rows.select("text", planted.alias("planted"), "kind", "times", (F.pmod(F.xxhash64(F.lit("h"), "shape", "i"), F.lit(4)) == 0).alias("held"))


def made_candidates(spark: SparkSession, n: int) -> DataFrame:
    """(kind, x, label, held): the candidates of the made texts, right (1) where they are what was planted."""
    finish = lambda kind, start, end, x: F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), x.alias("x"))
    rows = made_texts(spark, n).select("planted", "held", F.explode(proposed(F.col("text"), finish)).alias("c"))
    right = F.exists("planted", lambda p: (p["kind"] == F.col("c.kind")) & (p["start"] == F.col("c.start")) & (p["end"] == F.col("c.end")))
    return rows.select("c.kind", "c.x", right.cast("int").alias("label"), "held")


def trained(spark: SparkSession, n: int = TRAINING) -> tuple[list, list[float], dict[str, float]]:
    """(trees as nested tuples, their weights, threshold of each kind); fitted once per application."""
    key = f"{spark.sparkContext.applicationId}/{n}"
    if key in _models:
        return _models[key]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = written(made_candidates(spark, n).repartition(4, "kind", "held"), "candidates")
    # wrong candidates are many, so the right ones of a kind weigh as much as the wrong ones do together
    share = rows.filter("not held").groupBy("kind").agg((F.count_if(F.col("label") == 0) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1))).alias("ratio"))
    data = rows.join(F.broadcast(share), "kind").withColumn("weight", F.when(F.col("label") == 1, F.greatest("ratio", F.lit(1.0))).otherwise(1.0))
    data = data.select("kind", "held", "weight", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"), "x")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=24, stepSize=0.3, seed=3, weightCol="weight").fit(data.filter("not held"))

    def nested(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        return (node.split().featureIndex(), float(node.split().threshold()), nested(node.leftChild()), nested(node.rightChild()))

    trees = [nested(t._java_obj.rootNode()) if hasattr(t, "_java_obj") else nested(t.rootNode()) for t in model.trees]
    weights = [float(w) for w in model.treeWeights]
    held = data.filter("held").select("kind", "label", probability(F.col("x"), trees, weights).alias("p"))
    low = F.percentile("p", F.lit(1 - LET_THROUGH))
    limits = {r["kind"]: r["t"] for r in held.filter("label = 0").groupBy("kind").agg(low.alias("t")).collect()}
    thresholds = {k: max(0.5, limits.get(k, 0.5) + 1e-6) for k in KINDS}
    _models[key] = trees, weights, thresholds
    return _models[key]


def probability(x: Column, trees: list, weights: list[float]) -> Column:
    """The trees as one expression over the features."""

    def value(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        at, cut, left, right = node
        return F.when(F.element_at(x, at + 1) <= cut, value(left)).otherwise(value(right))

    total = F.lit(0.0)
    for tree, w in zip(trees, weights, strict=True):
        total = total + w * value(tree)
    return 1.0 / (1.0 + F.exp(-2.0 * total))


#: A candidate or a wall of the sweep, in the order that arrays of them are sorted by.
_ITEM = "struct<start:int,end:int,kind:string,p:double>"
#: Walls have a probability of 2; one at the end of all texts closes the sweep.
WALL, END = 2.0, 2**31 - 1


def item(start: Column, end: Column, kind: Column, p: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"), p.alias("p"))


def swept(items: Column) -> Column:
    """The candidates that overlap no wall and no likelier neighbour of the sweep, from items sorted by start; the last is the end.

    One candidate is open at a time; the next takes its place if they overlap and it is likelier.
    """
    none = item(F.lit(-1), F.lit(-1), F.lit(""), F.lit(-1.0))
    state = F.struct(F.lit(0).alias("wall"), none.alias("open"))

    def step(s: Column, x: Column) -> Column:
        held, is_wall, free = s["open"], x["p"] >= WALL, x["start"] >= s["wall"]
        better = (x["start"] >= held["end"]) | (x["p"] > held["p"]) | ((x["p"] == held["p"]) & (x["start"] == held["start"]))
        now = F.when(is_wall, none).when(free & better, x).otherwise(held)
        return F.struct(F.when(is_wall, F.greatest(s["wall"], x["end"])).otherwise(s["wall"]).alias("wall"), now.alias("open"))

    def emit(s: Column, x: Column) -> Column:
        held = s["open"]
        return F.when((held["p"] > 0) & (x["start"] >= held["end"]) & ((x["p"] >= WALL) | (x["start"] >= s["wall"])), held)

    return scan(items, state, _ITEM, step, emit)


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _pii_email, _ip, _card, _phone (base spans) and _pii_added: array<struct<start, end, kind, p>> of the trees' spans.

    A null text counts as empty. Positions are code points, ends exclusive. Added spans overlap neither
    base spans nor each other; of overlapping candidates the likelier, then the earlier, longer one stays.
    A second sweep adds what only overlapped candidates that lost in the first.
    """
    trees, weights, thresholds = trained(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_pii_text", text).withColumns({f"_pii_{k}": s for k, s in base_spans(F.col("_pii_text")).items()})
    limit = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in kv])
    finish = lambda kind, start, end, x: item(start, end, kind, probability(x, trees, weights))
    rows = rows.withColumn("_pii_loose", proposed(F.col("_pii_text"), finish, lambda c: c["p"] >= limit[c["kind"]]))
    wall = lambda s: item(s["start"], s["end"], F.lit(""), F.lit(WALL))
    walls = F.concat(F.array(item(F.lit(END), F.lit(END), F.lit(""), F.lit(WALL))), *[F.transform(f"_pii_{k}", wall) for k in KINDS])
    none = F.array().cast(f"array<{_ITEM}>")
    first = let(F.array_sort(F.concat("_pii_loose", walls)), swept)
    rows = rows.withColumn("_pii_added", F.when(F.size("_pii_loose") > 0, first).otherwise(none))
    second = let(F.array_sort(F.concat(F.col("_pii_loose"), walls, F.transform("_pii_added", wall))), swept)
    more = F.when(F.size("_pii_loose") > F.size("_pii_added"), second).otherwise(none)
    return rows.withColumn("_pii_added", F.concat("_pii_added", more)).drop("_pii_loose")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document; see spans()."""
    rows = spans(docs.select("doc_id", "text"))
    named = lambda k, of: F.transform(F.array_sort(of), lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    only = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    of_kind = lambda k: F.filter("_pii_added", lambda s: s["kind"] == k)
    both = [named(k, F.concat(only(F.col(f"_pii_{k}")), only(of_kind(k)))) for k in KINDS]
    base = F.array_join(F.concat(*[named(k, only(F.col(f"_pii_{k}"))) for k in KINDS]), ",")
    return rows.select("doc_id", *[F.size(f"_pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.concat(*both), ",").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; a null text stays null.

    Spans that overlap are replaced together, under the kind of the first. Other columns may have any names
    and types, and are left as they are; each row is judged by its own text, so null and repeated ids do no harm.
    """
    return under_safe_names(docs, ["text"], replaced)


def replaced(docs: DataFrame) -> DataFrame:
    kept = docs.columns
    rows = spans(docs)
    one = lambda k: F.transform(f"_pii_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k.upper()).alias("kind")))
    more = F.transform("_pii_added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind")))
    last = F.array(F.struct(F.lit(END).alias("start"), F.lit(END).alias("end"), F.lit("").alias("kind")))
    rows = rows.withColumn("_pii_all", F.array_sort(F.concat(*[one(k) for k in KINDS], more, last)))
    kind = "struct<prior:int,start:int,end:int,kind:string>"

    def step(held: Column, s: Column) -> Column:
        joined = F.struct(held["prior"].alias("prior"), held["start"].alias("start"), F.greatest(held["end"], s["end"]).alias("end"), held["kind"].alias("kind"))
        fresh = F.struct(F.greatest(held["end"], F.lit(0)).alias("prior"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.when(s["start"] >= held["end"], fresh).otherwise(joined)

    emit = lambda held, s: F.when((s["start"] >= held["end"]) & (held["start"] >= 0), held)
    open_ = F.struct(F.lit(0).alias("prior"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("kind"))
    rows = rows.withColumn("_pii_all", scan(F.col("_pii_all"), open_, kind, step, emit))

    def shown(part: Column) -> Column:
        """A run of spans with the text between them: cut from the text once, then inside the run."""
        lo, hi = part[0]["prior"], F.element_at(part, -1)["end"]
        piece = lambda cut, s: F.concat(F.substring(cut, s["prior"] - lo + 1, s["start"] - s["prior"]), F.lit("["), s["kind"], F.lit("]"))
        return let(F.substring(F.col("_pii_text"), lo + 1, hi - lo), lambda cut: F.array_join(F.transform(part, lambda s: piece(cut, s)), ""))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_pii_all") - 1) / CHUNK).cast("int")), lambda i: shown(F.slice("_pii_all", i * CHUNK + 1, F.lit(CHUNK))))
    end = F.element_at("_pii_all", -1)["end"]
    text = F.concat(F.array_join(runs, ""), F.substring("_pii_text", end + 1, F.length("_pii_text")))
    return rows.withColumn("text", F.when(F.col("text").isNull() | (F.size("_pii_all") == 0), F.col("text")).otherwise(text)).select(*kept)
