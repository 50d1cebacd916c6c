"""Secret scans: rules find candidates, a random forest removes false findings. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.store import written

#: Rules by kind, tried in this order on a word; group 1 is the candidate and ends the match.
RULES = {
    "aws_key": r"((?:AKIA|ASIA)[0-9A-Z]{16})(?![0-9A-Za-z])",
    "github_token": r"(gh[pousr]_[0-9A-Za-z]{30,})",
    "slack_token": r"(xox[abeoprs]-[0-9A-Za-z-]{10,})",
    "google_key": r"(AIza[0-9A-Za-z_-]{35})",
    "stripe_key": r"([rs]k_(?:live|test)_[0-9A-Za-z]{12,})",
    "jwt": r"(eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})",
    "assignment": r"""(?i)(?:passwd|password|pwd|secret|token|credential|api_?-?key|access_?-?key|auth)["']?(?:=|:=?)["']?([^\s"'<>,;]{6,})""",
    "generic": r"((?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[0-9A-Za-z+/_-]{20,}={0,2})",
}
#: A word that stands between a name and its value, and what may be such a value.
SIGNS = ["=", ":", ":=", "=>", "=="]
VALUE = r"""^["'`]?([^\s"'`<>,;]{6,})"""
#: A sign at the end of the name's word or at the start of the value's.
ENDED, LED = r"(?:={1,2}>?|:=?)$", r"^(?:={1,2}>?|:=?)"
LED_VALUE = LED + r"""["'`]?((?![=:>])[^\s"'`<>,;]{6,})"""
SPANS = "array<struct<rule:int,kind:string,candidate:string,from:int,to:int>>"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[0-9A-Za-z+/=\s\\]+-----END [A-Z ]*PRIVATE KEY-----"
#: Words whose share of a candidate is its dictionary coverage.
DICTIONARY = "admin|change|default|demo|dummy|example|fake|foobar|hello|here|insert|letmein|master|mock|pass|password|placeholder|qwerty|replace|sample|secret|super|test|token|user|value|welcome|word|your|key|name|null|none|true|false"
TELLING = r"(?i)(?:key|token|secret|passw|pwd|credential|auth|login|bearer|private|access)"
PLACEHOLDER = r"(?i)\b(?:example|sample|dummy|fake|test|mock|placeholder|redacted|todo|xxx|e\.g\.|like|such|format|checksum|commit|sha1|sha256|md5|digest|uuid|etag|hash|build|version|id)\b"
SAFE_PATH = r"(?i)(?:test|example|sample|fixture|mock|doc|spec|readme)"
FEATURES = ["length", "transitions", "classes", "digits", "upper", "coverage", "distinct", "hex", "ruled", "path_safe", "path_depth", "before_telling", "before_placeholder", "after_placeholder"]
TREES, DEPTH, LABELLED, SEED = 40, 8, 6000, 20240307
MARK = "[SECRET]"
#: Words whose lengths are summed beforehand, so that a finding's place takes a sum over blocks and one block's words.
BLOCK = 256
#: Documents whose secrets may be broadcast, of so many characters together; beyond either, texts are shuffled to them.
SENT_DOCS, SENT_CHARS = 500_000, 50_000_000


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def features(candidate: Column, kind: Column, path: Column, before: Column, after: Column) -> list[Column]:
    """The forest's inputs of a candidate; null paths and neighbours count as empty."""
    n = F.length(candidate)
    count = lambda p: F.size(F.regexp_extract_all(candidate, F.lit(p), F.lit(0)))
    # A transition is where a run of one character class ends and another begins.
    runs = count(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")
    covered = n - F.length(F.regexp_replace(F.lower(candidate), DICTIONARY, ""))
    path, before, after = (F.coalesce(c, F.lit("")) for c in (path, before, after))
    flag = lambda c, p: c.rlike(p).cast("double")
    values = [
        n.cast("double"),
        _share(runs - 1, n),
        sum((flag(candidate, p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^0-9A-Za-z]")), F.lit(0.0)),
        _share(count("[0-9]"), n),
        _share(count("[A-Z]"), n),
        _share(covered, n),
        _share(F.size(F.array_distinct(F.split(candidate, ""))), n),
        flag(candidate, r"^(?:[0-9a-f-]+|[0-9A-F-]+)$"),
        (~kind.isin("generic", "assignment")).cast("double"),
        flag(path, SAFE_PATH),
        F.size(F.split(path, "/")).cast("double"),
        F.greatest(flag(before, TELLING), (kind == "assignment").cast("double")),
        flag(before, PLACEHOLDER),
        flag(after, PLACEHOLDER),
    ]
    return [v.cast("double").alias(name) for v, name in zip(values, FEATURES)]


def labelled_findings(spark: SparkSession, n: int = LABELLED, seed: int = SEED) -> DataFrame:
    """(candidate, kind, path, before, after, label): made findings, half of them secrets, from rules and hashes of row numbers.

    Secrets are random strings in the forms of RULES; false ones are placeholders, words, digests, ids,
    links and variable names in the same places. Use findings that people have judged where there are any.
    """
    rows = spark.range(n, numPartitions=1)
    pick = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(f"{seed}{salt}")), F.lit(m))
    hexes = lambda salt, k: F.substring(F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(f"{seed}{salt}")).cast("binary"), 512), 1, k)
    mixed = lambda salt, k: F.substring(F.regexp_replace(F.base64(F.unhex(hexes(salt, 128))), r"[+/=]", ""), 1, k)

    def one(salt: str, *of: str) -> Column:
        return F.element_at(F.array(*map(F.lit, of)), pick(salt, len(of)).cast("int") + 1)

    word = lambda salt: one(salt, "the", "reader", "config", "server", "and", "of", "module", "value", "note", "entry", "thing", "for", "with", "over")
    upper = lambda salt, k: F.translate(F.upper(mixed(salt, k)), "0189", "ABYZ")
    long_word = F.concat(*[one(f"l{i}", "foo", "bar", "read", "write", "name", "file", "path", "size", "count", "index") for i in range(5)])
    kinds = F.array(*map(F.lit, ["aws_key", "assignment", "assignment", "generic", "github_token", "slack_token", "stripe_key", "generic", "assignment", "google_key", "jwt", "aws_key"]))
    kind = F.element_at(kinds, pick("k", 12).cast("int") + 1)
    true = (
        F.when(kind == "aws_key", F.concat(F.lit("AKIA"), upper("a", 16)))
        .when(kind == "github_token", F.concat(F.lit("ghp_"), mixed("g", 36)))
        .when(kind == "slack_token", F.concat(F.lit("xoxb-"), F.translate(hexes("s", 12), "abcdef", "123456"), F.lit("-"), mixed("s", 24)))
        .when(kind == "google_key", F.concat(F.lit("AIza"), mixed("z", 35)))
        .when(kind == "stripe_key", F.concat(F.lit("sk_live_"), mixed("t", 24)))
        .when(kind == "jwt", F.concat(F.lit("eyJ"), mixed("j", 20), F.lit(".eyJ"), mixed("w", 40), F.lit("."), mixed("x", 43)))
        .when(kind == "generic", F.when(pick("m", 2) == 0, mixed("y", 40)).otherwise(hexes("h", 40)))
        .otherwise(F.when(pick("m", 3) == 0, mixed("p", 12)).when(pick("m", 3) == 1, hexes("q", 18)).when(pick("m", 6) == 2, hexes("q", 40)).otherwise(F.concat(mixed("r", 9), F.lit("!"), mixed("u", 4))))
    )
    false = (
        F.when(kind == "aws_key", F.concat(F.lit("AKIA"), one("fa", "IOSFODNN7EXAMPLE", "EXAMPLEEXAMPLE12", "XXXXXXXXXXXXXXXX", "0000000000000000")))
        .when(kind == "github_token", F.concat(F.lit("ghp_"), one("fg", "x" * 36, "examplexampleexampleexampleexample12", "0" * 36)))
        .when(kind == "slack_token", one("fs", "xoxb-your-token-here", "xoxb-example-example", "xoxb-xxxxxxxxxx-xxxx"))
        .when(kind == "google_key", F.lit("AIza" + "X" * 35))
        .when(kind == "stripe_key", one("ft", "sk_test_exampleexample", "sk_test_yourkeyhere00", "sk_live_xxxxxxxxxxxxxxxx"))
        .when(kind == "jwt", F.lit("eyJexample00.eyJexample00.examplesignature"))
        .when(kind == "generic", F.when(pick("fm", 4) == 0, hexes("fh", 40)).when(pick("fm", 4) == 1, F.regexp_replace(hexes("fu", 32), r"(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")).when(pick("fm", 4) == 2, F.concat(long_word, F.lit("_v2"))).otherwise(F.concat(F.lit("docs/"), long_word, F.lit("/page1"))))
        .otherwise(one("fp", "changeme", "password", "your_password_here", "example123", "$PASSWORD", "os.environ.get", "getpass()", "test1234", "placeholder", "{password}", "null,", "request.token", "user.password", "default", "config.secret_name", "xxxxxxxx"))
    )
    label = pick("b", 2)
    made = rows.select("id", kind.alias("kind"), label.cast("double").alias("label"), F.when(label == 1, true).otherwise(false).alias("candidate"))
    keyed = one("n1", "key", "token", "secret:", "password", "auth", "the", "of", "value", "and", "with", "is", "reader")
    plain = one("n2", "commit", "checksum", "sha1", "example", "id", "version", "uuid", "test", "see", "hash", "like", "build")
    # A bare digest is a secret only by its neighbours; elsewhere neighbours tell little.
    bare = (F.col("kind") == "generic") & F.col("candidate").rlike("^[0-9a-f-]+$")
    before = F.when(bare & (label == 1), one("n3", "key =", "token =", "secret:", "apikey", "auth", "bearer", "TOKEN =")).when(bare, plain).when((label == 0) & (pick("n4", 2) == 0), plain).when(pick("n5", 3) == 0, keyed).otherwise(word("n6"))
    after = F.when((label == 0) & (pick("n7", 4) == 0), plain).otherwise(word("n8"))
    path = F.when((label == 0) & (pick("p1", 2) == 0), one("p2", "docs/example.md", "tests/fixture.py", "spec/sample.yml", "README.md")).when(pick("p3", 10) == 0, F.lit("tests/run.py")).otherwise(one("p4", "src", "src/app/config.py", "web", "src12", "deploy/env", "a/b/c.txt"))
    return made.select("candidate", "kind", path.alias("path"), before.alias("before"), after.alias("after"), "label")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest over FEATURES from labelled findings (candidate, kind, path, before, after, label 0 or 1); rows with a null candidate or label are left out."""
    rows = findings.where("candidate is not null and label is not null").withColumn("kind", F.coalesce("kind", F.lit("generic")))
    x = rows.select(F.col("label").cast("double").alias("label"), *features(*[F.col(c) for c in ("candidate", "kind", "path", "before", "after")])).coalesce(1)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(ready)


def candidates(docs: DataFrame, key: str, text: str, path: str | None) -> DataFrame:
    """(id, kind, candidate, start, before, after, path) of every rule's finding in whole texts; null texts have none.

    A word, which is what white space bounds, gives every match of every rule, but for those that a match
    of an earlier rule covers, and the value that a telling name is set to in another word, with a sign
    between them or at either's side; a name and a sign that are words of their own both are its
    neighbour. ``start`` is the candidate's first character, counted from 1. Private key blocks may span
    words; each is listed where it stands, equal ones too.
    """
    places = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"))
    w = F.col("w")
    some = "|".join(f"(?:{p})" for p in RULES.values()).replace("(?i)", "")
    some = some.replace("(?:(?:passwd", "(?:(?i:passwd", 1)
    runs = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    split = places.select("id", "path", runs(r"\S+").alias("w"), runs(r"\s+").alias("blanks"), F.col("text").rlike(r"^\s").cast("int").alias("lead"))

    def sums(of: str) -> Column:
        """The characters in each block of an array's strings."""
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(of) / BLOCK).cast("int")), lambda b: F.length(F.array_join(F.slice(of, b * BLOCK + 1, F.lit(BLOCK)), "")))

    def upto(of: str, n: Column) -> Column:
        """The characters in the first ``n`` strings of an array."""
        whole = F.floor(n / BLOCK).cast("int")
        return F.aggregate(F.slice(f"{of}_sums", F.lit(1), whole), F.lit(0), lambda x, y: x + y) + F.length(F.array_join(F.slice(of, whole * BLOCK + 1, n - whole * BLOCK), ""))

    split = split.where(F.size("w") > 0).select("*", sums("w").alias("w_sums"), sums("blanks").alias("blanks_sums"))

    def signed(i: Column) -> Column:
        return F.coalesce(F.get(w, i - 1).isin(*SIGNS), F.lit(False)) & (i >= 2)

    def told(i: Column) -> Column:
        return signed(i) & F.get(w, i - 2).rlike(TELLING) & F.get(w, i).rlike(VALUE)

    # The last and first characters are looked at before the longer patterns, as most words have no sign.
    def named(i: Column) -> Column:
        """The word before ends in a telling name and a sign."""
        name = F.get(w, i - 1)
        return (i >= 1) & F.coalesce(F.substring(name, -1, 1).isin("=", ":", ">") & name.rlike(TELLING + r"[^\s=:,;]*" + ENDED) & F.get(w, i).rlike(VALUE), F.lit(False))

    def led(i: Column) -> Column:
        """The word begins with a sign, after a telling name."""
        return (i >= 1) & F.coalesce(F.substring(F.get(w, i), 1, 1).isin("=", ":") & F.get(w, i).rlike(LED_VALUE) & F.get(w, i - 1).rlike(TELLING + r"[^\s=:,;]*$"), F.lit(False))

    at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ((F.length(F.get(w, i)) >= 8) & F.get(w, i).rlike(some)) | told(i) | named(i) | led(i))
    hits = split.select(
        "id",
        "path",
        F.explode(
            F.transform(
                at,
                lambda i: F.struct(
                    F.get(w, i).alias("word"),
                    F.when(signed(i), F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1))).when(i > 0, F.get(w, i - 1)).otherwise(F.lit("")).alias("before"),
                    (told(i) | named(i)).alias("told"),
                    led(i).alias("led"),
                    F.coalesce(F.get(w, i + 1), F.lit("")).alias("after"),
                    (upto("w", i) + upto("blanks", i + F.col("lead"))).alias("offset"),
                ),
            )
        ).alias("hit"),
    ).select("id", "path", "hit.*")

    def spans(order: int, kind: str, rule: str, where: Column, of: str = "word") -> Column:
        """All matches of a rule in a word; what splits by the rule leaves tells exactly where each ends, and each candidate ends its match."""
        gaps, whole, value = F.split(of, rule, -1), F.regexp_extract_all(of, F.lit(rule), F.lit(0)), F.regexp_extract_all(of, F.lit(rule), F.lit(1))
        steps = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.length(g) + F.length(m)), value, lambda n, v: F.struct(n.alias("n"), v.alias("candidate")))
        # The last gap has no match.
        steps = F.filter(steps, lambda x: x["candidate"].isNotNull())
        none = F.array().cast(SPANS)
        ended = F.aggregate(
            steps,
            F.struct(F.lit(0).alias("end"), none.alias("spans")),
            lambda acc, x: F.struct(
                (acc["end"] + x["n"]).alias("end"),
                F.concat(acc["spans"], F.array(F.struct(F.lit(order).alias("rule"), F.lit(kind).alias("kind"), x["candidate"].alias("candidate"), (acc["end"] + x["n"] - F.length(x["candidate"])).alias("from"), (acc["end"] + x["n"]).alias("to")))).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )
        return F.when(where, ended).otherwise(none)

    tried = [(k, p, F.col("word").rlike(p)) for k, p in RULES.items() if k != "generic"]
    tried += [("assignment", VALUE, F.col("told")), ("assignment", LED_VALUE, F.col("led")), ("generic", RULES["generic"], F.col("word").rlike(RULES["generic"]))]
    every = hits.withColumn("spans", F.concat(*[spans(i, *t) for i, t in enumerate(tried)]))
    # A span is left out only where one of an earlier rule covers all of it.
    own = F.filter("spans", lambda s: ~F.exists("spans", lambda e: (e["rule"] < s["rule"]) & (e["from"] <= s["from"]) & (e["to"] >= s["to"])))
    words = every.select("id", "offset", "before", "after", "path", F.explode(own).alias("found")).select(
        "id", "found.kind", "found.candidate", (F.col("offset") + F.col("found.from") + 1).cast("long").alias("start"), "before", "after", "path"
    )
    blocks = places.where(F.col("text").contains("PRIVATE KEY-----")).select("id", "path", F.explode(spans(0, "private_key", f"({PEM})", F.lit(True), "text")).alias("found"))
    blocks = blocks.select("id", "found.kind", "found.candidate", (F.col("found.from") + 1).cast("long").alias("start"), F.lit("").alias("before"), F.lit("").alias("after"), "path")
    return words.unionByName(blocks)


def scan(docs: DataFrame, key: str, text: str, path: str | None = None, model: RandomForestClassificationModel | None = None, threshold: float = 0.5) -> DataFrame:
    """(key, kind, candidate, start, before, after, path, score, is_secret): every candidate with the forest's score.

    Candidates scored under ``threshold`` are false findings. No step shuffles. Null texts have no
    candidates; rows of null or repeated keys are scanned like others; without a model one is trained on
    ``labelled_findings``. An empty table gives no rows.
    """
    model = model or train(labelled_findings(docs.sparkSession))
    found = candidates(docs, key, text, path)
    inputs = features(*[F.col(c) for c in ("candidate", "kind", "path", "before", "after")])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found.select("*", *inputs))
    scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    out = scored.select("id", "kind", "candidate", "start", "before", "after", "path", F.round("score", 6).alias("score"))
    return out.withColumn("is_secret", F.col("score") >= threshold).withColumnRenamed("id", key)


def redacted(docs: DataFrame, key: str, text: str, path: str | None = None, model: RandomForestClassificationModel | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with MARK for each secret, wherever in its document the secret's string stands; columns and rows as they were.

    Rows without a key are left as they are; of rows that repeat a key, each has the secrets of all removed.
    """
    secrets = scan(docs, key, text, path, model, threshold).where("is_secret").select(F.col(key).alias("__id"), "candidate")
    strings = secrets.groupBy("__id").agg(F.array_sort(F.collect_set("candidate"), lambda a, b: F.length(b) - F.length(a)).alias("__secrets"))
    clean = F.aggregate(F.coalesce("__secrets", F.array().cast("array<string>")), F.col(text), lambda t, s: F.replace(t, s, F.lit(MARK)))
    strings = written(strings, "secrets")
    size = strings.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.array_join("__secrets", ""))).alias("chars")).first()
    small = size.n <= SENT_DOCS and (size.chars or 0) <= SENT_CHARS
    joined = docs.join(F.broadcast(strings) if small else strings, docs[key] == strings["__id"], "left")
    return joined.select(*[clean.alias(c) if c == text else docs[c] for c in docs.columns])
