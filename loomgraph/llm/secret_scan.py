"""Secret scans with a random forest that removes false positives.

Every run of at least 16 characters of the alphabets that credentials use is a candidate,
and so is what is assigned to a credential word, whatever its length and alphabet: a quoted
value to its closing quote, a bare one to the next white space, less closing punctuation.
It is described by its length and make-up, by how usual its character transitions are in
the words of all documents, by the share of it that dictionary words cover, by its path,
and by the words around it.  A random forest trained on labelled findings then tells
credentials from long words, numbers, placeholders and identifiers.  Where nobody has
judged findings, labelled ones are planted: generated credentials, and generated values of
other kinds, are set amid words of the documents, so their labels are known and follow from
no feature.

All of it is DataFrame functions and the tree library's own transformers; no Python runs
on the executors.  Word counts, transitions and coverage come from all documents.

Defined results: null and empty texts have no candidates; each of several rows of one key
has its own; a null path is the empty path; where given labelled findings are not of both
kinds the score is the share of label 1 among them, 0 where there are none at all; very long
texts and values are taken whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, maybe_in, stash

#: Words that name a credential, and words that mark a stand-in for one.
CREDENTIAL = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_ -]?key|apikey|access[_ -]?key|private[_ -]?key|credential|bearer|auth)"
STAND_IN = r"(?i)(example|sample|dummy|placeholder|changeme|your[_ -]|xxxx|redacted|test)"

_CHAR = "[A-Za-z0-9+/_-]"
#: `=` belongs to a value only as padding: not where a value follows it, quoted or bare.
_PAD = rf"""(?!["'`]?[A-Za-z0-9+/_=-])"""
_RUN = rf"{_CHAR}{{16,}}(?:={{1,2}}{_PAD})?|{_CHAR}{{15}}={{1,2}}{_PAD}|{_CHAR}{{14}}=={_PAD}"
#: What stands before an assigned credential, after a first look that is quickly done.
_NAMED = CREDENTIAL.replace("(?i)", "").replace("(", "(?:")
_NEAR = r"""(?<=[ \t:=>"'`])(?<=[:=]>?[ \t]{0,8}["'`]?)"""
_GIVEN = rf"""(?i:{_NAMED})[\w.-]{{0,24}}["'`)\]]{{0,2}}[ \t]{{0,8}}[:=]{{1,3}}>?[ \t]{{0,8}}"""
_QUOTED = [rf"(?<={_GIVEN}{q})[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+){{0,200}}(?<!{q})(?={q})" for q in "\"'`"]
_BARE = rf"""(?<={_GIVEN}["'`]?)[^\s"'`=>](?:\S*[^\s"'`,;)\]}}>])?"""
_CANDIDATE = f"(?:{_NEAR}(?:{'|'.join([*_QUOTED, _BARE])})|{_RUN})"

#: Marks of a search, and what stands for them where a text has them itself: characters for private use.
_OPEN, _SHUT, _OTHER = "\ue000", "\ue001", "\ue002"
#: How public kinds of credentials begin.
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abp]-|sk[-_](live|test|proj)|sk-|rk_live_|AIza|ya29|eyJ[A-Za-z0-9]|SG\.|npm_|hf_|pypi-)"

FEATURES = ["length", "digits", "capitals", "symbols", "variety", "changes", "usual", "least_usual", "covered", "hex", "stand_in", "credential_before", "named", "issued", "userinfo", "assigned", "quoted", "credential_after", "path_depth", "path_test"]


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of all runs of three or more letters a-z, A-Z lower-cased."""
    words = docs.select(F.explode(F.split(ascii_lower(F.col(text)), "[^a-z]+")).alias("word"))
    return words.where(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"))


def transition_table(words: DataFrame) -> list[float]:
    """Log-probability of each letter after each, 26 x 26 in order, smoothed by one."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))).alias("pair"), "n")
    # at most 26 x 26 rows
    n = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    table = []
    for a in letters:
        total = sum(n.get(a + b, 0) for b in letters) + 26
        table += [math.log((n.get(a + b, 0) + 1) / total) for b in letters]
    return table


def candidates(docs: DataFrame, key: str, text: str, path: str, around: int = 10) -> DataFrame:
    """(row, at, key, digest, path, start, value, before, after): every candidate of every text,
    with the 48 characters on either side of it; digest: of the text.

    One search sets a mark before and behind each candidate; what stands between the marks
    gives offsets and neighbours.  No 48 characters hold more than `around` candidates.
    """
    # characters that are marks here are other ones of no meaning while the text is searched
    clean = F.translate("text", _OPEN + _SHUT, _OTHER * 2)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("digest"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("text"))
    # a look that is quickly done
    rows = rows.where(F.col("text").rlike(f"{_CHAR}{{14}}|{CREDENTIAL}")).withColumn("row", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace(clean, _CANDIDATE, f"{_OPEN}$0{_SHUT}"), _OPEN)
    odd = F.when(F.col("text").rlike(f"[{_OPEN}{_SHUT}]"), F.col("text"))
    each = rows.select("row", "key", "digest", "path", odd.alias("odd"), F.posexplode(parts).alias("at", "part"))
    at = F.when(F.col("at") == 0, 0).otherwise(F.instr("part", _SHUT))  # behind the value
    value, gap = F.substring(F.col("part"), F.lit(1), at - 1), F.substring(F.col("part"), at + 1, F.length("part"))
    each = each.select("row", "at", "key", "digest", "path", "odd", value.alias("value"), gap.alias("gap"))
    each = each.select("*", F.concat("value", "gap").alias("plain"))
    w = Window.partitionBy("row").orderBy("at")
    joined = lambda c, lo, hi: F.array_join(F.collect_list(c).over(w.rowsBetween(lo, hi)), "")
    upto = F.sum(F.length("plain")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("plain")
    short = each.withColumn("first", F.left("plain", F.lit(48))).withColumn("last", F.right("plain", F.lit(48))).withColumn("gap", F.left("gap", F.lit(48)))
    out = short.withColumn("start", upto.cast("long")).withColumn("before", F.right(joined("last", -around, -1), F.lit(48))).withColumn("after", F.left(F.concat("gap", F.when(F.length("gap") < 48, joined("first", 1, around)).otherwise("")), F.lit(48)))
    # where a text has marks of its own, what was searched is not quite what it says
    again = lambda c, lo, n: F.when(F.col("odd").isNull(), F.col(c)).otherwise(F.substring(F.col("odd"), lo.cast("int"), n.cast("int"))).alias(c)
    from_ = F.greatest(F.col("start") - 47, F.lit(1))
    shown = [again("value", F.col("start") + 1, F.length("value")), again("before", from_, F.col("start") + 1 - from_), again("after", F.col("start") + F.length("value") + 1, F.lit(48))]
    return out.where("at > 0").select("row", (F.col("at") - 1).alias("at"), "key", "digest", "path", "start", *shown)


def described(found: DataFrame, words: DataFrame, transitions: list[float], usual_from: int = 5) -> DataFrame:
    """`found` with FEATURES.  Words seen at least `usual_from` times are the dictionary."""
    low = ascii_lower(F.col("value"))
    size = F.length("value").cast("double")
    share = lambda alphabet: F.length(F.regexp_replace("value", f"[^{alphabet}]", "")) / size
    table = F.lit(transitions)
    inside = lambda x: (x >= 0) & (x < 26)
    codes = F.transform(F.split(low, ""), lambda x: F.ascii(x) - F.lit(97))
    later = F.slice("codes", 2, F.length("value") - 1)
    steps = F.zip_with(F.slice("codes", 1, F.length("value") - 1), later, lambda x, y: F.when(inside(x) & inside(y), F.get(table, x * 26 + y)).otherwise(F.lit(-7.0)))
    chunk = F.explode(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0)))
    known = words.where(F.col("n") >= usual_from).select("word")
    cover = found.select("row", "at", chunk.alias("word")).join(known, "word").groupBy("row", "at").agg(F.sum(F.length("word")).alias("chars"))
    out = found.join(cover, ["row", "at"], "left").withColumn("codes", codes).withColumn("steps", steps)
    columns: dict[str, Column] = {
        "length": F.log(size), "digits": share("0-9"), "capitals": share("A-Z"), "symbols": share("+/_=-"),
        "variety": F.size(F.array_distinct(F.split("value", ""))) / size,
        "changes": F.size(F.regexp_extract_all("value", F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), F.lit(0))) / size,
        "usual": F.aggregate("steps", F.lit(0.0), lambda a, x: a + x) / size, "least_usual": F.array_min("steps"),
        "covered": F.coalesce("chars", F.lit(0)) / size,
        "hex": low.rlike("^[0-9a-f]+$").cast("double"), "stand_in": F.col("value").rlike(STAND_IN).cast("double"),
        "credential_before": F.col("before").rlike(CREDENTIAL).cast("double"), "named": F.col("before").rlike(rf"""{_GIVEN}["'`]?$|(?i:bearer|basic)[ \t]+$""").cast("double"), "issued": F.col("value").rlike(ISSUED).cast("double"),
        "userinfo": (F.col("before").rlike(r"://[^\s/@:]*:$") & F.col("after").startswith("@")).cast("double"), "assigned": F.col("before").rlike(r"[:=]>?\s*[\"'`]?$").cast("double"),
        "quoted": F.col("before").rlike(r"[\"'`]$").cast("double"), "credential_after": F.col("after").rlike(CREDENTIAL).cast("double"),
        "path_depth": (F.size(F.split("path", "/")) - 1).cast("double"), "path_test": F.col("path").rlike(STAND_IN).cast("double"),
    }
    return out.withColumns(columns).drop("codes", "steps", "chars")


def planted(docs: DataFrame, key: str, text: str, path: str, sample_rows: int, seed: int = 13) -> DataFrame:
    """(id, path, text, start, value, label, kind): generated findings amid words of `docs`, stored; kind: the place of its template.

    Half of the credentials have no credential word before them, and half of the others have one.

    Of about `sample_rows` rows, each sampled document has one of every kind; values follow
    from a hash of its key and text.
    """
    hashed = lambda n: F.sha2(F.concat_ws(":", F.col("own"), F.lit(n)), 256)
    coded = lambda n: F.regexp_replace(F.base64(F.unhex(hashed(n))), r"\s", "")
    web = lambda n: F.translate(coded(n), "+/=", "-_")
    digits = lambda n: F.translate(hashed(n), "abcdef", "417203")
    part = lambda c, n: F.substring(c, 1, n)
    near = lambda n: F.element_at("words", F.lit(n))  # noqa: E731  words around it
    short = F.concat(part(coded(1), 5), F.translate(part(hashed(2), 1), "0123456789abcdef", "!@#$%&*?!@#$%&*?"), part(coded(3), 4), part(digits(4), 2))
    uuid = F.concat_ws("-", part(hashed(5), 8), part(hashed(6), 4), part(hashed(7), 4), part(hashed(8), 4), part(hashed(9), 12))
    camel = F.regexp_replace(F.initcap(F.concat_ws(" ", *[near(i) for i in range(1, 6)])), r"[^\p{L}]", "")
    snake = F.lower(F.regexp_replace(F.concat_ws("_", F.lit("get"), near(2), near(3), near(4), F.lit("from_settings")), r"[^\w]", ""))
    kinds: list[tuple[int, str, Column, str]] = [
        (1, 'token = "', part(hashed(10), 40), '"'), (1, "API_KEY=", part(web(11), 32), ""), (1, 'password: "', short, '"'),
        (1, '"client_secret": "', coded(12), '"'), (1, "Authorization: Bearer ", part(web(13), 40), ""), (1, "aws_secret_access_key = ", part(coded(14), 40), ""),
        (1, "passwd='", F.concat(part(coded(15), 9), part(digits(16), 3)), "'"), (1, "auth_token: ", part(hashed(17), 32), ""),
        (1, "", F.concat(F.lit("AKIA"), part(F.upper(F.translate(coded(28), "+/=", "QZX")), 16)), ""), (1, "", F.concat(F.lit("ghp_"), part(F.translate(coded(29), "+/=", "aZ7"), 36)), ""), (1, "key ", F.concat(F.lit("sk_live_"), part(F.translate(coded(30), "+/=", "bY5"), 24)), ""),
        (1, "", F.concat(F.lit("eyJhbGciOiJ"), part(web(31), 20)), "." ), (1, "postgres://admin:", F.concat(part(F.translate(coded(32), "+/=", "cX3"), 14), part(digits(33), 4)), "@db/main"), (1, "", F.concat(F.lit("xoxb-"), part(digits(34), 12), F.lit("-"), part(F.translate(coded(35), "+/=", "dW2"), 24)), ""),
        (1, 'password = "', F.concat_ws(" ", *[F.lower(F.regexp_replace(near(i), r"[^\p{L}]", "x")) for i in (5, 6, 7)]), '"'), (1, "secret: '", F.concat_ws("-", *[F.lower(F.regexp_replace(near(i), r"[^\p{L}]", "y")) for i in (8, 9, 10, 11)]), "'"),
        (0, "the auth commit ", part(hashed(36), 40), ""), (0, "token counts of batch ", part(digits(37), 18), ""), (0, "secret sharing, see sha256:", hashed(38), ""), (0, "password reset for order ", part(digits(39), 16), ""), (0, "private key rotation ", uuid, ""),
        (0, "the access key module ", snake, ""), (0, "credentials checked in build ", part(hashed(40), 24), ""), (0, "auth service at ", F.concat(F.lit("/srv/"), F.concat_ws("/", *[F.regexp_replace(near(i), r"[^\w]", "") for i in range(3, 7)])), ""), (0, "img/png;base64,", F.concat(coded(41), coded(42)), ""), (0, "https://host:", F.concat(part(digits(43), 4), F.lit("/"), snake), ""),
        (0, "commit ", part(hashed(18), 40), ""), (0, "sha256:", hashed(19), ""), (0, 'etag: "', part(hashed(20), 32), '"'), (0, 'id = "', uuid, '"'),
        (0, 'token = "', F.concat(F.lit("your-token-"), near(1), F.lit("-here-xxxx")), '"'), (0, "password: ", F.concat(F.lit("${"), F.upper(snake), F.lit("}")), ""),
        (0, "api_key = ", F.concat(F.lit("settings."), snake), ""), (0, 'password = "', F.concat(F.lit("changeme_example_"), part(digits(21), 2)), '"'),
        (0, "order ", part(digits(22), 16), ""), (0, "", F.concat(F.lit("/usr/share/"), F.concat_ws("/", *[F.regexp_replace(near(i), r"[^\w]", "") for i in range(1, 5)])), ""),
        (0, "class ", camel, ""), (0, "", F.lower(camel), ""), (0, "see ", F.concat(part(digits(23), 9), F.lit("-"), part(digits(24), 9)), ""), (0, "data: ", F.concat(coded(25), coded(26), coded(27)), ""),
    ]
    n = max(1, docs.count())
    own = F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(seed))
    some = docs.where(F.pmod(own, F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / len(kinds) / n) * (1 << 30))))
    some = some.select(own.alias("own"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.split(F.coalesce(F.col(text), F.lit("")), r"\s+").alias("w"))
    # sixteen words from somewhere in the text, made up to as many with one that is always there
    at = F.pmod(F.col("own"), F.greatest(F.lit(1), F.size("w") - 15)).cast("int") + 1
    some = some.withColumn("words", F.concat(F.slice("w", at, F.lit(16)), F.array_repeat(F.lit("word"), 16))).drop("w")
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("label"), F.lit(a).alias("ahead"), v.alias("value"), F.lit(b).alias("behind"), F.lit(i).alias("kind")) for i, (y, a, v, b) in enumerate(kinds)]))
    rows = some.select("path", F.concat(F.array_join(F.slice("words", 1, 8), " "), F.lit(" ")).alias("head"), F.array_join(F.slice("words", 9, 8), " ").alias("tail"), each.alias("k"))
    text_ = F.concat("head", "k.ahead", "k.value", "k.behind", F.lit(" "), "tail")
    return stash(rows.select(F.monotonically_increasing_id().alias("id"), "path", text_.alias("text"), (F.length("head") + F.length("k.ahead")).cast("long").alias("start"), "k.value", "k.label", "k.kind"))


def planted_findings(docs: DataFrame, words: DataFrame, transitions: list[float], key: str, text: str, path: str, sample_rows: int = 20_000) -> DataFrame:
    """Described candidates with their `label`, as found among planted ones."""
    rows = planted(docs, key, text, path, sample_rows)
    found = stash(candidates(rows, "id", "text", "path"))
    truth = rows.select(F.col("id").alias("key"), "start", "value", "label", "kind")
    return described(found.join(truth, ["key", "start", "value"]), words, transitions)


@dataclass
class SecretModel:
    forest: RandomForestClassificationModel | None
    base: float | None

    def score(self, findings: DataFrame) -> DataFrame:
        """`findings` with a score from 0 to 1."""
        if self.forest is None:
            return findings.withColumn("score", F.lit(self.base or 0.0))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(findings)
        return self.forest.transform(vectors).withColumn("score", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")


def train(labelled: DataFrame, sample_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 9) -> SecretModel:
    """Fit on at most about `sample_rows` findings of each label (0 or 1), evenly by hash.

    `labelled`: described findings with a column `label`.
    """
    labelled = labelled.where(F.col("label").isin(0, 1))
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(n) < 2:
        return SecretModel(None, float(next(iter(n))) if n else None)
    h = F.pmod(F.xxhash64("value", "start", F.lit(seed)), F.lit(1 << 30))
    most = F.when(F.col("label") == 1, F.lit(sample_rows / n[1])).otherwise(F.lit(sample_rows / n[0])) * F.lit(float(1 << 30))
    sample = stash(labelled.where(h < most).select("label", *FEATURES))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(sample)
    if sample.select("label").distinct().count() < 2:
        return SecretModel(None, n[1] / (n[0] + n[1]))
    return SecretModel(RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors), None)


def findings(docs: DataFrame, words: DataFrame, transitions: list[float], key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate of `docs` with its FEATURES; the search over the texts is stored and runs once."""
    return described(stash(candidates(docs, key, text, path)), words, transitions)


def scan(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str = "source", threshold: float = 0.5) -> DataFrame:
    """(key, start, length, value, score, is_secret, digest) of every candidate; digest: of the text.

    `labelled`: judged findings (from `findings`, with a 0/1 column `label`); without any,
    the forest learns from planted ones.
    """
    words = stash(word_counts(docs, text))
    transitions = transition_table(words)
    model = train(planted_findings(docs, words, transitions, key, text, path) if labelled is None else labelled)
    scored = model.score(findings(docs, words, transitions, key, text, path))
    return scored.select(F.col("key").alias(key), "start", F.length("value").cast("long").alias("length"), "value", "score", (F.col("score") >= threshold).alias("is_secret"), "digest")


def redacted(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret of `found` replaced by `mark`; texts without any stay where they are.

    Findings belong to rows by key and text, so null keys and repeated keys are served alike.
    """
    secrets = found.where("is_secret").groupBy(F.col(key).alias("__key"), F.col("digest").alias("__digest")).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("__gone"))
    secrets = stash(secrets)
    digest = F.xxhash64(F.col(text))
    flagged = maybe_in(docs, digest, secrets.select("__digest"))
    ends = F.concat(F.transform("__gone", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("__gone", lambda s: s["end"]))
    pieces = F.zip_with(begins, ends, lambda b, e: F.substring(F.col(text), (b + 1).cast("int"), (e - b).cast("int")))
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(pieces, mark))
    some = flagged.where("__maybe").join(secrets, (digest == F.col("__digest")) & F.col(key).eqNullSafe(F.col("__key")), "left").withColumn(text, cleaned).select(*docs.columns)
    return flagged.where(~F.col("__maybe")).select(*docs.columns).unionByName(some)
