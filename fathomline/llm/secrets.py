"""Secret scan with a random forest that removes false positives.

Candidates are the long runs of key characters with a digit among the words of a text, and what is assigned to names
such as token or password. Each is described by its length, its character transitions (how likely its pairs of letters
are in words, and how its kinds of characters change), the share of it that dictionary words cover, its path, and the
words before and after it. A random forest trained on labelled findings decides. Everything is DataFrame functions and Spark ML.

Findings never carry the secret itself: they have its SHA-256 and its first four characters.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import log2

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Findings that the forest is trained on at most.
TRAIN_ROWS = 6000
TREES, DEPTH = 30, 8
#: Pieces that copies of one text are dealt to when they are redacted.
SALTS = 16
CORE = r"[A-Za-z0-9+/_\-]{14,}={0,2}"
#: A value, a sign of assignment, and a name with such a sign, as they are looked for in a few words.
VALUE = r"[A-Za-z0-9+/_\-!@#$%^&*.~]{8,}"
SIGN = r"(?::=|=>|[=:])[\"']?"
NAMED = r"(?i)(?:secret|token|passw|pwd|api.?key|access.?key|credential|auth)[\w.\-]{0,20}[\"']?\s{0,2}" + SIGN + r"\s{0,2}[\"'`(]{0,2}"
DICTIONARY = (
    "about access account address admin after again agent alpha apple application archive article auto back base batch beta block board body book branch bucket buffer build button "
    "cache call card case catalog change check city class client cloud code color column commit common component config content context control copy core count country course data "
    "date default delete delta demo design detail device digest direct domain download draft error event example export field file filter final first folder form format forum frame "
    "from function gamma general graph group hash head header health history home host hour house html image import index info input issue item java json label language last layer "
    "left level library light line link list local login main manager market master media member memory message meta method model module month name network node note number object "
    "office open option order page paper part password path people phone place plan point policy post price print product profile program project public query quick read record "
    "region release report request response review root route sample school script search section secret select server service session simple site size source space start state "
    "stat status step store stream string style summary support system table target team template test text theme this time title token tool topic track type update upload user "
    "value version video view water week width window word work world year"
).split()
KEY_WORDS = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|private|credential|auth|bearer|signature|client.?id|key$)"
HASH_WORDS = r"(?i)(commit|sha|md5|checksum|hash|digest|revision|rev$|uuid|guid|etag|object|tree|parent|version|build|image|layer|blob|integrity)"
FAKE_WORDS = r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx|fake|test|redacted|1234|abcdef|0000)"
FAKE_PATHS = r"(?i)(test|spec|example|sample|fixture|mock|vendor|node_modules|\.lock|lock\.json|\.sum|\.min\.|dist/|docs?/)"

FEATURES = (
    "length", "digits", "uppers", "hexes", "transitions", "changes", "repeats", "steps", "vowels", "distinct", "covered",
    "assigned", "quoted", "known", "key_near", "hash_near", "fake_near", "fake_self", "fake_path", "follows",
)


def _word(words: Column, at: Column) -> Column:
    return F.coalesce(F.get(words, at), F.lit(""))


def candidates(df: DataFrame, text_col: str = "text", path_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each candidate: the columns ``keep``, ``path``, ``word_no``, ``before`` (two words), ``word``, ``after``
    and ``core``. A null or empty text has none; texts are searched whole. A run that a word has twice is one candidate.

    Candidates are runs of 14 or more key characters with a digit, and whatever of 8 or more characters is assigned to
    a name such as token or password, symbols and letters alone included.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    some = text.rlike(CORE) | text.rlike(NAMED)
    rows = df.where(some).select(*[df[c] for c in keep], (df[path_col] if path_col else F.lit(None)).cast("string").alias("path"), F.split(text, r"[\s\x00]+").alias("words"))
    words = F.col("words")

    def named(at: Column, word: Column) -> Column:
        # Cheap tests first: few words hold or follow a sign of assignment.
        signed = word.rlike(r"[=:]") | _word(words, at - 1).rlike(SIGN + "$")
        return word.rlike(VALUE) & signed & F.concat_ws(" ", _word(words, at - 2), _word(words, at - 1), word).rlike(NAMED + VALUE)

    rows = rows.withColumn("at", F.explode(F.filter(F.transform("words", lambda w, i: F.when(w.rlike(CORE) | named(i, w), i)), lambda i: i.isNotNull())))
    near = lambda k: _word(words, F.col("at") + k)
    rows = rows.select(*keep, "path", F.col("at").cast("long").alias("word_no"), F.concat(near(-2), F.lit(" "), near(-1)).alias("before"), near(0).alias("word"), near(1).alias("after"), named(F.col("at"), near(0)).alias("named"))
    # A word may hold several runs: each is a candidate.
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({CORE})"), F.lit(1)), lambda c: c.rlike(r"[0-9]"))
    inner = F.regexp_extract("word", rf"{SIGN}[\"'`(]*({VALUE}={{0,2}})", 1)
    whole = F.regexp_extract("word", rf"^[\"'`(]*({VALUE}={{0,2}})", 1)
    value = F.when(F.char_length(inner) > 0, inner).otherwise(whole)
    assigned = F.when(F.col("named") & (F.char_length(value) > 0), F.array(value)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("core", F.explode(F.array_distinct(F.concat(runs, assigned)))).drop("named")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.greatest(whole, F.lit(1)), F.lit(0.0))


def transition_costs(dictionary: list[str] = DICTIONARY) -> dict[str, float]:
    """How much likelier each pair of letters is in the dictionary's words than by chance: log2, with half a count added.

    Pairs that no word has cost what ``""`` says.
    """
    counts = Counter(a + b for w in dictionary for a, b in zip(w, w[1:]))
    total = sum(counts.values()) + 26 * 26 / 2
    return {"": log2(26 * 26 / 2 / total)} | {k: log2((n + 0.5) * 26 * 26 / total) for k, n in sorted(counts.items())}


def features(found: DataFrame, dictionary: list[str] = DICTIONARY) -> DataFrame:
    """``found`` with the columns FEATURES. Missing neighbours and paths count as empty."""
    core, n = F.col("core"), F.char_length("core")
    count = lambda pattern: n - F.char_length(F.regexp_replace(core, pattern, ""))
    # The class of each character: d, u, l or s; then where it changes.
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(core, r"[^A-Za-z0-9]", "~"), r"[a-z]", "l"), r"[A-Z]", "u"), r"[0-9]", "d")
    changes = F.char_length(kinds) - F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    repeats = n - F.char_length(F.regexp_replace(core, r"(.)\1+", "$1"))
    words = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
    rest = F.regexp_replace(F.lower(core), f"(?:{words})", "")
    # The mean over the run's pairs of neighbouring letters, from a Markov chain of the dictionary; 0 without such pairs.
    costs = transition_costs(dictionary)
    table = F.str_to_map(F.lit(",".join(f"{k}:{v:.4f}" for k, v in costs.items() if k)), F.lit(","), F.lit(":"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(F.lower(core), i, F.lit(2)))
    pairs = F.filter(pairs, lambda p: p.rlike("^[a-z]{2}$"))
    sums = F.aggregate(pairs, F.lit(0.0), lambda total, p: total + F.coalesce(F.element_at(table, p).cast("double"), F.lit(costs[""])))
    codes = F.transform(F.split(core, ""), lambda c: F.ascii(c))
    steps = F.size(F.filter(F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: b - a), lambda d: d == 1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    path, before, word, after = (F.coalesce(F.col(c), F.lit("")) for c in ("path", "before", "word", "after"))
    lead = F.concat(before, F.lit(" "), F.substr(word, F.lit(1), F.instr(word, core) - 1))
    out = {
        "length": F.log(n.cast("double")),
        "digits": _share(count("[0-9]"), n),
        "uppers": _share(count("[A-Z]"), n),
        "hexes": _share(count("[0-9a-f]"), n),
        "transitions": sums / F.greatest(F.size(pairs), F.lit(1)),
        "changes": 1 - _share(changes, n),
        "repeats": _share(repeats, n),
        "steps": _share(steps, n),
        "vowels": _share(count("[aeiouAEIOU]"), n),
        "distinct": _share(F.size(F.array_distinct(F.split(core, ""))), n),
        "covered": _share(n - F.char_length(rest), n),
        "assigned": flag(lead.rlike(r"[=:]>?\s*[\"']?$")),
        "quoted": flag(lead.rlike(r"[\"']$")),
        "known": flag(core.rlike(r"^(AKIA|ASIA|ghp_|gho_|ghs_|xox[abpr]-|sk_live_|sk-|AIza|glpat-|eyJ)")),
        "key_near": flag(lead.rlike(KEY_WORDS)),
        "hash_near": flag(lead.rlike(HASH_WORDS)),
        "fake_near": flag(F.concat(lead, F.lit(" "), after).rlike(FAKE_WORDS)),
        "fake_self": flag(core.rlike(FAKE_WORDS)),
        "fake_path": flag(path.rlike(FAKE_PATHS)),
        "follows": flag(after.rlike(r"^[\"';,)}]|^$")),
    }
    return found.withColumns({k: v.cast("double") for k, v in out.items()})


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Made-up findings with labels (``text``, ``path``, ``label``) for sessions that bring none of their own.

    The same rows every time. Label 1: keys of well-known shapes, and random hexadecimal, base-64 and mixed strings
    after words such as token or password, passwords of 8 characters and more, keys of letters alone. Label 0: commit ids,
    checksums, UUIDs, long numbers, names of files and identifiers with digits, counted-up strings, placeholders, words that
    are assigned to such names, and keys in tests and examples.
    """
    i = F.col("id")
    h = lambda k: F.sha2(F.concat(i.cast("string"), F.lit(f":{k}")).cast("binary"), 256)
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    b64 = lambda k: F.regexp_replace(F.base64(F.unhex(h(k))), r"\s", "")
    upper = lambda k: F.upper(F.regexp_replace(b64(k), r"[^A-Za-z0-9]", "7"))
    filler = ("the", "of", "and then", "value is", "la", "der", "as", "was", "set", "with", "in this", "to", "een")
    key = pick("key", ("token", "secret", "password", "api_key", "apikey", "access_key", "client_secret", "auth_token", "passwd", "private_key", "DB_PASSWORD", "SECRET_KEY"))
    sign = pick("sign", (" = ", "=", ": ", " := ", ":", "= "))
    q = pick("quote", ('"', "'", "", ""))
    plain = pick("plain", ("src/app.py", "config/settings.yml", "deploy/prod.env", "main.tf", "", "notes.txt", "src4"))
    word = pick("word", DICTIONARY[::5])
    other = pick("other", DICTIONARY[2::7])
    sized = lambda s, least, most: F.substr(s, F.lit(1), (F.lit(least) + F.pmod(F.xxhash64(i, F.lit("size")), F.lit(most - least + 1))).cast("int"))
    letters = F.translate(h(8), "0123456789", "ghkmpqrtwz")
    mixed = F.translate(b64(9), "+/=", "k7Q")
    lead, tail = pick("lead", filler), pick("tail", (*filler, "", ";", "***", "###", "."))
    made = [
        (1, F.concat(key, sign, q, sized(h(1), 16, 64), q), plain),
        (1, F.concat(key, sign, q, sized(h(2), 18, 40), q), plain),
        (1, F.concat(key, sign, q, sized(b64(3), 20, 43), q), plain),
        (1, F.concat(F.lit("AKIA"), F.substring(upper(4), 1, 16)), plain),
        (1, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64(5), r"[+/=]", "x"), 1, 36)), plain),
        (1, F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(b64(6), r"[+/=]", "x"), 1, 24)), plain),
        (1, F.concat(F.lit("Authorization: Bearer "), sized(b64(7), 24, 43)), plain),
        (1, F.concat(key, sign, q, sized(mixed, 8, 13), q), plain),
        (1, F.concat(key, sign, q, F.concat(F.initcap(other), F.substring(F.regexp_replace(h(10), "[a-f]", "4"), 1, 4), pick("odd", ("!", "#", "$", "!!", "@1"))), q), plain),
        (1, F.concat(key, sign, q, sized(letters, 16, 40), q), plain),
        (0, F.concat(key, sign, q, F.concat(word, pick("join", ("_", "-", "", ".")), other), pick("rest", ("_name", "_field", "less", "_type")), q), plain),
        (0, F.concat(pick("c", ("commit ", "sha ", "revision ", "parent ", "tree ", "merge ")), F.substring(h(11), 1, 40)), plain),
        (0, F.concat(pick("m", ("md5 ", "sha256:", "checksum ", "digest sha256:", "integrity sha512-", "etag ")), sized(h(12), 32, 64)), plain),
        (0, F.concat_ws("-", F.substring(h(13), 1, 8), F.substring(h(13), 9, 4), F.substring(h(13), 13, 4), F.substring(h(13), 17, 4), F.substring(h(13), 21, 12)), plain),
        (0, sized(F.regexp_replace(h(14), "[a-f]", "3"), 14, 20), plain),
        (0, F.concat(word, F.lit("_"), other, F.lit("_"), word, F.substring(F.regexp_replace(h(15), "[a-f]", "1"), 1, 3)), plain),
        (0, F.concat(word, F.lit("-"), other, F.lit("-"), word, F.lit("-2024-v"), F.substring(h(16), 1, 1), F.lit("7")), plain),
        (0, F.concat(F.lit("/"), word, F.lit("/"), other, F.lit("/"), word, F.lit("_"), F.substring(F.regexp_replace(h(17), "[a-f]", "1"), 1, 5)), plain),
        (0, F.concat(key, sign, q, pick("ph", ("your_token_here_123", "XXXXXXXXXXXXXXXXXXXX1", "changeme1234567890", "abcdef0123456789abcdef", "00000000000000000000", "example_key_1234567")), q), plain),
        (0, F.concat(key, sign, q, sized(h(18), 16, 64), q), pick("tp", ("tests/test_auth.py", "examples/demo.yml", "package-lock.json", "vendor/lib.js", "go.sum", "spec/fixtures/a.json"))),
        (0, F.concat(other, F.lit(" "), sized(h(19), 16, 40)), pick("lk", ("yarn.lock", "poetry.lock", "dist/app.min.js", "docs/hashes.md"))),
        (0, F.concat(F.lit("https://"), word, F.lit("/"), other, F.lit("/"), F.substring(h(20), 1, 20)), plain),
    ]
    each = -(-rows // len(made))
    parts = [
        spark.range(k * each, (k + 1) * each, numPartitions=1).select(F.concat_ws(" ", lead, t, tail).alias("text"), p.alias("path"), F.lit(label).cast("double").alias("label"))
        for k, (label, t, p) in enumerate(made)
    ]
    return reduce(DataFrame.union, parts)


def train(findings: DataFrame, text_col: str = "text", path_col: str | None = "path", label_col: str = "label", most_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH):
    """A forest from labelled findings: each row's candidates take the row's label. At most ``most_rows`` rows, those
    with the smallest hashes. Null labels and texts are left out; both labels must occur."""
    some = findings.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).orderBy(F.xxhash64(text_col), text_col).limit(most_rows)
    rows = features(candidates(some, text_col, path_col, keep=(label_col,)))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", F.col(label_col).cast("double").alias("label")).coalesce(2).persist()
    try:
        if data.select("label").distinct().count() < 2:
            raise ValueError("findings of both labels are needed")
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, subsamplingRate=0.8).fit(data)
    finally:
        data.unpersist()


def scan(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """A row for each candidate in ``df``: ``id_col``, ``word_no`` (the word's place in the text, from 0),
    ``length``, ``shown`` (first four characters), ``candidate_sha256``, ``score`` (the forest's share for a secret)
    and ``is_secret``.

    Null and empty texts give no row; repeated rows give repeated rows; a null id stays null.
    """
    path = (df[path_col] if path_col else F.lit(None)).cast("string")
    rows = df.select(df[id_col].alias("__id"), df[text_col].alias("text"), path.alias("path"))
    found = features(candidates(rows, "text", "path", keep=("__id",)))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    score = F.round(vector_to_array("probability")[1], 12)
    return scored.select(
        F.col("__id").alias(id_col),
        "word_no",
        F.char_length("core").cast("long").alias("length"),
        F.substring("core", 1, 4).alias("shown"),
        F.sha2(F.col("core").cast("binary"), 256).alias("candidate_sha256"),
        score.alias("score"),
        (score >= threshold).alias("is_secret"),
    )


def redact(df: DataFrame, model, text_col: str = "text", path_col: str | None = None, mask: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """``df`` with every finding that the forest calls a secret replaced by ``mask`` in its text.

    Rows are told apart by their text and path alone, so copies are redacted alike; other columns stay as they are.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    path = F.coalesce(df[path_col].cast("string"), F.lit("")) if path_col else F.lit("")
    key = F.sha2(F.concat(text, F.lit("\x00"), path), 256)
    keyed = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), key.alias("key"), text.alias("text"), path.alias("path"))
    some = F.col("text").rlike(CORE) | F.col("text").rlike(NAMED)
    once = keyed.where(some).groupBy("key").agg(F.first("text").alias("text"), F.first("path").alias("path"))
    found = features(candidates(once, "text", "path", keep=("key",)))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    bad = scored.where(vector_to_array("probability")[1] >= threshold).groupBy("key").agg(F.collect_set("core").alias("cores"))
    # A text of very many copies is dealt to several tasks.
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(bad, ["key", "salt"], "left")
    cleaned = F.aggregate(F.array_sort("cores", lambda a, b: F.length(b) - F.length(a)), F.col("text"), lambda t, c: F.replace(t, c, F.lit(mask)))
    new = F.when(F.col("cores").isNull(), F.col("row")[text_col]).otherwise(cleaned)
    return dealt.select(*[new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
