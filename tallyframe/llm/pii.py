"""Personal data and credentials by weak supervision, in DataFrame functions only.

Strict patterns find the base spans. Loose patterns add candidates (spelled-out addresses, numbers without a plus sign,
15-digit cards, plain runs of digits, long runs of letters and digits that may be keys, ...). On every candidate labelers vote
yes, no or nothing: the strict pattern, gazetteers, the words before it (a card or an order number, a token or a checksum), its
shape and its borders. Expectation-maximisation over the table of vote patterns, whose size depends on the number
of labelers alone, estimates how reliable each labeler is for each kind; a logistic classifier is then trained on the
posteriors and decides about the candidates that no base span covers. Base spans always stay.
"""

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import documents, packed, stored
from tallyframe.llm.registry import query
from tallyframe.session import quoted

BASE_KINDS = ["email", "ip", "card", "phone"]
# A secret (key, token, password) has no strict pattern: all its spans are decided by the classifier.
KINDS = [*BASE_KINDS, "secret"]

# The strict patterns. A run that fails at its first character fails at the later ones too, so a match starts
# at the border of a run or where the last match ended; that keeps long runs linear.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
STRICT = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}+(?:\.{_LABEL}+)+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9][0-9 -]++",  # where separators that don't stand between two digits are masked
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Texts without a match of the gate have no match of the pattern.
STRICT_GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
_RUN = "[A-Za-z0-9_+/-]"
_LOOSE_SEPARATOR = r"(?: ?\. ?| ?[\[({]dot[\])}] ?| dot )"
LOOSE = {
    "email": rf"(?i)(?<!{_LOCAL}){_LOCAL}++(?: ?[\[({{]at[\])}}] ?{_LABEL}+(?:{_LOOSE_SEPARATOR}{_LABEL}+)+"
             rf"| at {_LABEL}+(?: dot {_LABEL}+)+)",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{4}(?:[._/ -]{1,3}[0-9]{4}){3}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])",
    "secret": rf"(?<!{_RUN})(?={_RUN}*?[0-9])(?={_RUN}*?[A-Za-z]){_RUN}{{16,}}+={{0,2}}",
}
LOOSE_GATE = {"email": r"(?i)[\[({]at[\])}]| dot ", "ip": r"[0-9][\[(]\.", "card": r"[0-9]{4}", "phone": r"[0-9]{2}\)?[ .-][0-9]", "secret": rf"{_RUN}{{16}}"}
# Gazetteers and context words, also those that speak against a kind.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot\W*)(?:com|org|net|edu|gov|mil|int|info|biz|io|eu|de|fr|es|it|nl|be|at|ch|uk|us|ca|mx|br|ar|pl|se|no|dk|fi|pt|ru|jp|cn|in|au|nz)$",
    "ip": r"^(?!0)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+?(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?0|^\(?[2-9][0-9]{2}\)?[ .-]",
    "secret": r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|sk_test_|pk_live_|rk_live_|xox[abp]-|npm_|eyJ)",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|correo|courriel|kontakt|schreib)",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|adresse|dirección)",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|anruf|appel|llam)",
    "secret": r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer|contraseña|mot de passe|kennwort)",
}
AGAINST = {
    "email": r"(?i)(?:meet|arriv|look|laugh|point)\w* $",
    "ip": r"(?i)(?:version|release|section|chapter|build|\bv)[ .:]*$",
    "card": r"(?i)(?:order|invoice|tracking|serial|isbn|barcode|commande|bestell|pedido|reference|ref)\W*(?:number|no|nr|id)?\W*$",
    "phone": r"(?i)(?:order|invoice|tracking|serial|isbn|part|commande|bestell|pedido|reference|ref|since|from|years?|in)\W*(?:number|no|nr|id)?\W*$",
    "secret": r"(?i)(?:commit|revision|checksum|sha-?[0-9]*|md5|digest|hash|uuid|guid|etag|file|image|path|https?:/*\S*|www\.\S*)\W*$",
}
LABELERS = ["strict", "gazetteer", "context", "shape", "border"]
CONTEXT_CHARS = 40
# A longer run of characters is data, not a key.
SECRET_CHARS = 512
THRESHOLD = 0.5
EM_ROUNDS = 50
# What EM assumes of every labeler beforehand: how often it is right, on how many candidates for each real one.
ASSUMED_RIGHT = {"strict": 0.95, "gazetteer": 0.65, "context": 0.95, "shape": 0.75, "border": 0.6}
ASSUMED_SHARE = 0.5
# Chance that a base span is what it looks like.
BASE_CHANCE = 0.99

_HITS = "array<struct<start:int,end:int,s:string>>"


def _hits(text: Column, pattern: str, gate: str, within: Column | None = None) -> Column:
    """Matches of `pattern` in `text` as array of (start, end, s) in code points; `within` is text with masked characters.

    The pieces between the matches give their places.
    """
    look = text if within is None else within
    gaps, found = F.split(look, pattern, -1), F.regexp_extract_all(look, F.lit(pattern), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_HITS).alias("out"))
    begin = begin.withField("out", F.array().cast(_HITS))

    def step(state, pair):
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), pair["hit"].alias("s")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found,
                       lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = F.aggregate(pairs, begin, step, lambda s: s["out"])
    return F.when(text.rlike(gate), spans).otherwise(F.array().cast(_HITS))


def _each(make, kind: str):
    """`make` for one kind, as the function of one element that array functions take."""
    return lambda element: make(kind, element)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is right."""
    def add(total, i):
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _sound(kind: str, s: Column) -> Column:
    """Whether a match passes the check of its kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.split(F.regexp_replace(s, r"[\[\]()]", ""), r"\.")
        return F.forall(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(s)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _masked(text: Column) -> Column:
    """The text with one control character for each separator that doesn't stand between two digits."""
    return F.when(text.rlike(STRICT_GATE["card"]), F.regexp_replace(text, "(?<![0-9])[ -]|[ -](?![0-9])", "\x01")).otherwise("")


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Add `_text` (null: empty) and the array of base spans of every kind, `_base_<kind>`."""
    df = df.withColumn("_text", F.coalesce(quoted(text), F.lit("")))
    for kind in BASE_KINDS:
        within = _masked(F.col("_text")) if kind == "card" else None
        hits = _hits(F.col("_text"), STRICT[kind], STRICT_GATE[kind], within)
        df = df.withColumn(f"_all_{kind}", hits)
        df = df.withColumn(f"_base_{kind}", F.filter(f"_all_{kind}", _each(lambda k, h: _sound(k, h["s"]), kind)))
    return df.withColumn("_base_secret", F.array().cast(_HITS)).drop(*[f"_all_{k}" for k in BASE_KINDS])


def _votes(kind: str, h: Column, strict: bool) -> Column:
    """Struct of the labelers' votes (1, -1, 0) and two surface features of a candidate."""
    text, s = F.col("_text"), h["s"]
    before = F.substring(text, F.greatest(h["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(h["start"], F.lit(CONTEXT_CHARS)))
    left, right = F.substring(before, -1, 1), F.substring(text, h["end"] + 1, F.lit(2))
    digits = _digits(s)
    listed = F.when(s.rlike(GAZETTEER[kind]), 1).otherwise(0 if kind == "secret" else -1)
    named = F.when(before.rlike(AGAINST[kind]), -1).when(before.rlike(CONTEXT[kind]), 1).otherwise(0)
    joined = left.rlike("[A-Za-z0-9]") | right.rlike("^[-_/]?[A-Za-z0-9]")
    border = F.when(joined, -1).otherwise(1)
    if kind == "secret":
        # Drawn characters are seldom the same, and digits and letters alternate often; words and names aren't like that.
        turns = F.length(F.regexp_replace(s, "[0-9]+|[^0-9]+", "x"))
        shape = F.when(F.length(s) > SECRET_CHARS, -1).when((F.size(F.array_distinct(F.split(s, ""))) >= 10) & (turns >= 5), 1).otherwise(-1)
        border = F.when(before.rlike("[=:] ?[\"'`]?$"), 1).when(joined | left.isin("/", ".", "@", "#"), -1).otherwise(0)
    elif kind == "email":
        shape = F.when(F.length(s) <= 120, 1).otherwise(-1)
    elif kind == "card":
        shape = F.when(F.length(digits).between(13, 19) & _luhn(digits), 1).otherwise(-1)
    else:
        shape = F.when(_sound(kind, s), 1).otherwise(-1)
    votes = {"strict": F.lit(1 if strict else 0), "gazetteer": listed, "context": named, "shape": shape, "border": border}
    return F.struct(*[votes[n].cast("int").alias(n) for n in LABELERS], F.least(F.length(s) / 40.0, F.lit(1.0)).alias("_len"),
                    F.least(F.length(digits) / 20.0, F.lit(1.0)).alias("digits"))


def with_candidates(df: DataFrame) -> DataFrame:
    """Add `_more_<kind>`: loose candidates outside the base spans of all kinds, each with its votes."""
    base = F.concat(*[F.col(f"_base_{k}") for k in KINDS])
    df = df.withColumn("_base", base)
    for kind in KINDS:
        loose = _hits(F.col("_text"), LOOSE[kind], LOOSE_GATE[kind])
        free = F.filter(loose, lambda h: ~F.exists("_base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
        voted = F.transform(free, _each(lambda k, h: h.withField("votes", _votes(k, h, False)), kind))
        df = df.withColumn(f"_more_{kind}", voted)
    return df.drop("_base")


def _vote_row(kind: str, votes: Column) -> Column:
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), votes.alias("v"))


def vote_table(df: DataFrame) -> DataFrame:
    """(kind, votes, surface features, n) summed over all candidates and base spans of all texts."""
    rows = F.flatten(F.array(*[
        F.concat(F.transform(f"_base_{k}", _each(lambda k, h: _vote_row(k, _votes(k, h, True)), k)),
                 F.transform(f"_more_{k}", _each(lambda k, h: _vote_row(k, h["votes"]), k)))
        for k in KINDS]))
    one = df.select(F.explode(rows).alias("r")).select("r.kind", "r.v.*")
    return one.groupBy(*one.columns).agg(F.count("*").alias("n"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = EM_ROUNDS) -> dict:
    """Posterior of "personal data" for every (kind, votes), by EM over votes that are independent given the truth.

    Each labeler has, per kind, the chances of a yes and a no on the true and on the false candidates that it votes on,
    beside assumed candidates, a fixed share of the real ones, on which it is right as often as assumed; silent, it says nothing. The start is the share of yes among the votes. A base
    span (yes of the strict pattern, the first labeler) counts as true throughout and shows what the others say to true ones.
    """
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        known = BASE_CHANCE if kind < len(BASE_KINDS) else None
        post = [known if known and v[0] == 1 else (1 + v.count(1)) / (2 + v.count(1) + v.count(-1)) for v, _ in rows]
        assumed = 1 + ASSUMED_SHARE * sum(n for _, n in rows)
        for _ in range(rounds):
            open_ = [(n, p) for (v, n), p in zip(rows, post) if not (known and v[0] == 1)]
            prior = math.log(sum(n * p for n, p in open_) + assumed) - math.log(sum(n * (1 - p) for n, p in open_) + assumed)
            chance = []
            for j, right in enumerate(ASSUMED_RIGHT[name] for name in LABELERS):
                yes, no = ([sum(n * q for (v, n), q in zip(rows, side) if v[j] == x) + assumed * (right if x == expected else 1 - right) for x in (1, -1)]
                           for side, expected in ((post, 1), ([1 - p for p in post], -1)))
                chance.append({x: math.log(a / sum(yes)) - math.log(b / sum(no)) for x, a, b in zip((1, -1), yes, no)})
            post = [known if known and v[0] == 1 else 1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(
                chance[j][x] for j, x in enumerate(v) if x))))) for v, _ in rows]
        out |= {(kind, v): p for (v, _), p in zip(rows, post)}
    return out


class SpanClassifier:
    """Logistic weights per kind over the votes and surface features of a candidate."""

    FEATURES = [*LABELERS, "_len", "digits"]

    def __init__(self, weights: dict[str, tuple[float, list[float]]]):
        self.weights = weights

    def accepts(self, kind: str, votes: Column) -> Column:
        if kind not in self.weights:
            return F.lit(False)
        bias, weights = self.weights[kind]
        score = F.lit(bias)
        for name, w in zip(self.FEATURES, weights):
            score = score + F.lit(w) * votes[name]
        return 1 / (1 + F.exp(-score)) >= THRESHOLD


def train(votes: DataFrame) -> SpanClassifier:
    """Classifier from a stored vote table. Its patterns of votes, 3 ** labelers per kind at most, reach the driver."""
    seen = votes.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).collect()
    post = reliabilities([(r["kind"], tuple(r[n] for n in LABELERS), float(r["n"])) for r in seen])
    weights = {}
    for i, kind in enumerate(KINDS):
        own = {v: p for (k, v), p in post.items() if k == i}
        if not any(v[0] == 0 for v in own):  # all candidates are base spans: nothing to decide
            continue
        chance = F.create_map(*[x for v, p in own.items() for x in (F.lit(",".join(map(str, v))), F.lit(p))])
        rows = votes.where(F.col("kind") == i).withColumn(
            "p", F.element_at(chance, F.concat_ws(",", *[F.col(n).cast("string") for n in LABELERS])))
        both = rows.withColumn("label", F.lit(1.0)).withColumn("weight", F.col("n") * F.col("p")).union(
            rows.withColumn("label", F.lit(0.0)).withColumn("weight", F.col("n") * (1 - F.col("p"))))
        features = VectorAssembler(inputCols=SpanClassifier.FEATURES, outputCol="features").transform(both)
        fitted = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=25).fit(features)
        weights[kind] = (float(fitted.intercept), [float(w) for w in fitted.coefficients])
    return SpanClassifier(weights)


def find(df: DataFrame, text: str) -> DataFrame:
    """Add `_base_<kind>` and `_spans_<kind>` (base and accepted spans by start): arrays of (start, end, s) in code points.

    The whole text is searched, a null one is empty. Two passes: one gathers the vote table, one decides. Repeated rows
    vote as often as they stand; an empty table stays empty, and columns of other names stay as they are.
    """
    wide = with_candidates(with_base(df, text))
    votes = stored(vote_table(with_candidates(with_base(df.select(quoted(text)), text))))
    decide = train(votes)
    for kind in KINDS:
        more = F.filter(f"_more_{kind}", _each(lambda k, h: decide.accepts(k, h["votes"]), kind))
        bare = F.transform(more, lambda h: F.struct(h["start"], h["end"], h["s"]).cast("struct<start:int,end:int,s:string>"))
        wide = wide.withColumn(f"_spans_{kind}", F.array_sort(F.concat(f"_base_{kind}", bare)))
    return wide.drop(*[f"_more_{k}" for k in KINDS])


def _listed(prefix: str) -> Column:
    """kind:start:end of all spans, by kind as listed, then start."""
    return F.array_join(F.flatten(F.array(*[
        F.transform(f"{prefix}{k}", _each(
            lambda k, h: F.concat_ws(":", F.lit(k), h["start"].cast("string"), h["end"].cast("string")), k))
        for k in KINDS])), ",")


def redact(df: DataFrame, text: str) -> DataFrame:
    """`df` with every span in `text` replaced by its kind, such as <EMAIL>; overlapping spans become one.

    Texts without spans, null ones among them, stay as they are; all other columns do, whatever their names and types.
    """
    found = find(packed(df, text=quoted(text)), "text")
    spans = F.array_sort(F.flatten(F.array(*[
        F.transform(f"_spans_{k}", _each(lambda k, h: F.struct(
            h["start"].alias("start"), h["end"].alias("end"), F.lit(f"<{k.upper()}>").alias("as")), k))
        for k in KINDS])))
    found = found.withColumn("_cut", spans)

    def step(state, s):
        fresh = s["start"] >= state["at"]
        kept = F.concat(state["out"], F.substring(F.col("_text"), state["at"] + 1, s["start"] - state["at"]), s["as"])
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.when(fresh, kept).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_cut", begin, step, lambda s: F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, F.length("_text"))))
    new = F.when(F.size("_cut") > 0, clean).otherwise(F.col("text"))
    return found.select(*[new.alias(c) if c == text else F.col("own").getField(c).alias(c) for c in df.columns])


@query()
def op7_pii(spark, folder):
    found = find(documents(spark, folder).select("doc_id", "text"), "text")
    return found.select("doc_id", *[F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(_listed("_base_"), 256).alias("base_sha256"), _listed("_spans_").alias("spans"),
                        F.size("_spans_secret").cast("long").alias("n_secret"),
                        sum((F.size(f"_spans_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_spans"))
