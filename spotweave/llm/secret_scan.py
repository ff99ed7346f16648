"""Secret scan: candidates by shape, a random forest against false positives, DataFrame functions only.

Candidates are words of the text that look like a credential. Each gets features of its length, its character
transitions, its dictionary coverage, the document's path (source) and its neighbouring words; a random
forest learned from labelled findings decides. Nothing is shuffled: a document is scanned in its own row.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm.common import keep_columns, named
from spotweave.session import stage

MIN_LENGTH = 12
THRESHOLD = 0.5
TREES = 24
DEPTH = 6
PER_KIND = 160  # generated findings of each kind

# Vendor shapes of credentials, assignment words, words of harmless contexts and of placeholders.
SHAPES = {
    "aws_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}", "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}", "slack_token": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}", "stripe_key": r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:(?s:.*?)-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----|\s*[A-Za-z0-9+/=\\]*)",
}
VENDOR = "|".join(SHAPES.values())
ASSIGNED = r"(?i)(?:password|passwd|pwd|secret|token|api_?-?key|apikey|access_?-?key|private_?-?key|auth|credential|bearer)"
HARMLESS = r"(?i)(?:commit|sha1|sha256|md5|checksum|digest|revision|uuid|guid|phone|tel|call|card|iban|order|invoice|isbn|version|http|www|example|sample|dummy|placeholder|test|mock|fixture)"
DICTIONARY = ("password", "passwd", "secret", "token", "changeme", "example", "sample", "dummy", "test", "user", "admin", "default", "value",
              "your", "here", "insert", "replace", "placeholder", "letmein", "welcome", "qwerty", "abcdef", "abc", "foobar", "foo", "bar",
              "none", "null", "true", "false", "the", "and", "for", "with", "from", "this", "that", "have", "not", "are", "was", "all", "new",
              "data", "file", "name", "path", "key", "config", "service", "version", "release", "build", "index", "page", "http", "www", "com",
              "org", "net", "image", "table", "column", "document", "license", "public", "private", "system", "server", "client", "message",
              "number", "string", "object", "time", "date", "day", "year", "month", "world", "hello", "license", "report", "project")
FEATURES = ("length", "digits", "upper", "lower", "symbols", "distinct", "entropy", "transitions", "word_pairs", "hex_only", "digits_only",
            "coverage", "repeats", "assigned_before", "marked_before", "assigned_within", "quoted", "harmless_near", "harmless_path", "vendor_shape")

EDGES = r"^[\"'`(\[{<]+|[\"'`)\]}>.,;:!?%$#&*]+$"
VALUE_AFTER = r"(?s)^(?:[A-Za-z_.-]{2,40}[=:]+)?[\"'`]*(.*)$"
# An assigned value inside a word: quoted up to its quote, bare up to a mark.
VALUE = r"(?:[\\\"'`]+[^\\\"'`]{8,}|[^\\\"'`&,;<>(){}\[\]]{8,})"
PAIR = ASSIGNED + r"[A-Za-z0-9_.-]{0,20}[\\\"'`]*[=:]+" + VALUE
PAIR_PARTS = r"(?s)^([A-Za-z0-9_.-]+)[\\\"'`]*[=:]+[\\\"'`]*(.*)$"
ASSIGNS = ASSIGNED + r"[A-Za-z0-9_.-]{0,20}[\\\"'`]*\x20?[=:]+$"  # the words before end in an assignment


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def words_of(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+")


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(word, EDGES, ""), VALUE_AFTER, 1), EDGES, "")


def _pieces(word: Column, before: Column) -> Column:
    """The word itself, and what it holds besides: assigned values as ``name=value``, vendor shapes, the value its words before assign."""
    pairs = F.transform(F.regexp_extract_all(word, F.lit(PAIR), F.lit(0)), lambda p: F.regexp_replace(p, PAIR_PARTS, "$1=$2"))
    head = F.when(before.rlike(ASSIGNS), F.regexp_extract(word, "^" + VALUE, 0)).otherwise("")
    parts = F.concat(pairs, F.array(head), F.regexp_extract_all(word, F.lit(VENDOR), F.lit(0)))
    # Each value of a word once, as its first piece.
    return F.aggregate(parts, F.array(word), lambda kept, p: F.when(
        F.exists(kept, lambda k: _bare(k) == _bare(p)), kept).otherwise(F.concat(kept, F.array(p))))


def _shaped(word: Column) -> Column:
    return word.rlike(f"[0-9]|=|{VENDOR}")


def may_hold(text: Column) -> Column:
    """Whether a text can hold a candidate: an assignment word, a shaped word of at least 8 characters or a key block; null for null."""
    return text.rlike(ASSIGNED) | text.contains("-----BEGIN") | F.exists(words_of(text), lambda w: (F.length(w) >= 8) & _shaped(w))


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = "source") -> DataFrame:
    """Candidate words of whole texts: ``doc_id``, ``place`` (word number), ``value``, context columns.

    A candidate is a word of ``MIN_LENGTH`` characters or more with a digit, or any word of at least 8 that has an assignment word in its own
    ``name=`` or ``name:`` or in the two words before it, after quotes, marks and the leading name are taken off; also a whole block of
    a private key, at the place where it begins. Vendor shapes and assigned values inside a word are candidates of the word's place too, so
    text without white space is searched as well. Length excludes nothing. Null texts have none.
    """
    body = F.col("body")
    two = lambda i: F.concat_ws(" ", F.slice("words", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))))
    assigned = lambda w, i: w.rlike(ASSIGNED) | two(i).rlike(ASSIGNED)

    def likely(test) -> Column:
        """The words that pass, with what stands around them."""
        return F.filter(F.transform("words", lambda w, i: F.when((F.length(w) >= 8) & test(w, i), F.struct(
            i.alias("place"), w.alias("word"), F.concat_ws(" ", F.slice("words", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))).alias("before"),
            F.coalesce(F.get("words", i + 1), F.lit("")).alias("after")))), lambda x: x.isNotNull())

    # A block's place is the number of the word it begins in.
    begins = lambda acc, b: F.call_function("locate", b, body, acc["upto"])
    blocks = F.aggregate(
        F.when(body.contains("-----BEGIN"), F.regexp_extract_all(body, F.lit(SHAPES["private_key"]), F.lit(0))).otherwise(F.array().cast("array<string>")),
        F.expr("cast(named_struct('upto', 1, 'found', array()) as struct<upto:int,found:array<struct<place:int,word:string,before:string,after:string>>>)"),
        lambda acc, b: F.struct((begins(acc, b) + F.length(b)).alias("upto"), F.concat(acc["found"], F.array(F.struct(
            (F.size(words_of(F.substring(body, F.lit(1), begins(acc, b) - 1))) - 1).alias("place"), b.alias("word"), F.lit("").alias("before"), F.lit("").alias("after")))).alias("found")))["found"]
    found = (docs.select(named(key).alias("doc_id"), named(path).alias("path") if path in docs.columns else F.lit(None).cast("string").alias("path"), named(text).alias("body"))
             .filter(may_hold(body)).withColumns({"words": words_of(body), "assigns": F.coalesce(body.rlike(ASSIGNED), F.lit(False))})
             # One of two passes over the words is chosen per text. Inside a lambda a test of the whole text would run once per word.
             .select("doc_id", "path", F.explode(F.concat(blocks, F.when(F.col("assigns"), likely(lambda w, i: _shaped(w) | assigned(w, i)))
                                                          .otherwise(likely(lambda w, i: _shaped(w))))).alias("c")))
    word, two_before = F.col("c.word"), F.substring_index("c.before", " ", -2)
    pieces = F.when(word.startswith("-----BEGIN "), F.array(word)).otherwise(_pieces(word, two_before))
    return with_value(found.select("doc_id", "path", "c.place", F.explode(pieces).alias("word"), "c.before", "c.after"))


def with_value(found: DataFrame) -> DataFrame:
    """The value inside a candidate word, and whether it is long enough to be looked at."""
    valued = found.withColumn("value", _bare(F.col("word"))).withColumn("named", F.regexp_extract("word", r"^[\"'`(\[{<]*([A-Za-z_.-]{2,40})[=:]", 1))
    return valued.filter(
        ((F.length("value") >= MIN_LENGTH) & F.col("value").rlike("[0-9]"))
        | ((F.length("value") >= 8) & (F.col("named").rlike(ASSIGNED) | F.substring_index("before", " ", -2).rlike(ASSIGNED)))
        | F.col("value").startswith("-----BEGIN "))


def with_features(found: DataFrame) -> DataFrame:
    """Feature columns of candidates, all doubles."""
    v = F.col("value")
    # Each distinct character is counted by one native pass over the value.
    counts = F.transform("_chars", lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / F.length(v))
    vendor = F.lit(False)
    for shape in SHAPES.values():
        vendor = vendor | v.rlike(f"^(?:{shape})$")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    covered = F.lower(v)
    return (found.withColumn("_chars", F.array_distinct(F.split(v, ""))).select(
        *found.columns,
        F.length(v).cast("double").alias("length"), _share(v, "[0-9]").alias("digits"), _share(v, "[A-Z]").alias("upper"), _share(v, "[a-z]").alias("lower"),
        _share(v, "[^A-Za-z0-9]").alias("symbols"), (F.size("_chars") / F.length(v)).alias("distinct"),
        F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)).alias("entropy"),
        _share(v, "[a-z](?=[0-9A-Z])|[0-9](?=[A-Za-z])|[A-Z](?=[0-9a-z])").alias("transitions"),
        _share(v, "(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])").alias("word_pairs"),
        flag(v.rlike("^[0-9a-fA-F]+$")).alias("hex_only"), flag(v.rlike("^[0-9.+() -]+$")).alias("digits_only"),
        (1 - F.length(F.regexp_replace(covered, "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), "")) / F.length(v)).alias("coverage"),
        _share(v, r"(.)(?=\1)").alias("repeats"),
        flag(F.col("before").rlike(ASSIGNED)).alias("assigned_before"), flag(F.col("before").rlike(ASSIGNS)).alias("marked_before"), flag(F.col("named").rlike(ASSIGNED)).alias("assigned_within"),
        flag(F.col("word").rlike("[\"'`]")).alias("quoted"),
        flag(F.col("before").rlike(HARMLESS) | F.col("after").rlike(HARMLESS)).alias("harmless_near"),
        flag(F.col("path").rlike(HARMLESS)).alias("harmless_path"), flag(vendor).alias("vendor_shape")))


def labelled_findings(spark: SparkSession, per_kind: int = PER_KIND, first: int = 0) -> DataFrame:
    """Labelled findings made from counters by digests: ``word``, ``before``, ``after``, ``path``, ``label`` (1: a secret).

    Counters begin at ``first``; other counters give other values.

    Secrets: random hexadecimal and base64 values in assignments, vendor keys. Others: card, phone and order numbers, dates, versions,
    digests of commits and files, identifiers, placeholders, addresses, dictionary words with a number. Pass your own reviewed
    findings with these columns to :func:`fit` instead where you have them.
    """
    n = F.col("id")
    hexed, text = F.sha2(n.cast("string"), 256), F.base64(F.unhex(F.sha2((n + 7_000_000).cast("string"), 256)))
    upper = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", "Q"))
    size = (n % 5) * 6 + 14
    digits = F.regexp_replace(hexed, "[a-f]", "7")
    pick = lambda *options: F.get(F.array(*[F.lit(o) for o in options]), (F.xxhash64(n) % len(options) + len(options)) % len(options))
    plain = lambda: pick("and then the", "of it", "pour la", "und der", "que los", "see also", "")
    named_ = lambda: pick("token =", "secret =", "api_key =", "auth token:", "access_key :", "the password is", "export SECRET =")
    # A lambda over a sequence, which keeps the expression small.
    many = lambda step, count: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.base64(F.unhex(F.sha2((n * 31 + step + k).cast("string"), 256)))), "")
    url64 = lambda c: F.translate(c, "+/=", "-_")
    phrase = F.translate(hexed, "0123456789abcdef", "aeiorstnlmdpuchb")  # letters only
    phrase = F.substring(F.when(n % 3 == 0, F.initcap(phrase)).otherwise(phrase), 1, 9 + n % 12)
    blank = pick("your-token-here", "changeme", "example-secret", "placeholder", "insert_token_here", "xxxxxxxxxxxx", "test_password", "default_value", "password")
    kinds = [
        # word, before, label
        (F.concat(F.lit('"'), F.substring(hexed, 1, 40), F.lit('"')), named_(), 1),
        (F.concat(F.lit('"'), F.expr("substring(hexed, 1, cast(size as int))"), F.lit('"')), named_(), 1),
        (F.concat(pick("password=", "passwd=", "secret=", "token=", "api_key="), F.expr("substring(hexed, 1, cast(size as int))")), plain(), 1),
        (F.concat(pick("password=", "pwd=", "API_KEY=", "auth:"), F.expr("substring(text, 1, cast(size as int))")), plain(), 1),
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain(), 1),
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), named_(), 1),
        (F.concat(F.lit("ghp_"), F.substring(F.concat(text, hexed), 1, 36)), plain(), 1),
        (F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(text, "[^A-Za-z0-9]", "x"), 1, 24)), named_(), 1),
        (F.substring(text, 1, 40), named_(), 1),
        (F.concat(pick("4", "5", "37"), F.substring(digits, 1, 15)), plain(), 0),
        (F.concat(pick("4", "5"), F.substring(digits, 1, 15)), pick("card number", "card", "order"), 0),
        (F.concat(F.lit("+1("), F.substring(digits, 1, 3), F.lit(")"), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4)), pick("call", "phone", "tel"), 0),
        (F.substring(hexed, 1, 40), pick("commit", "revision", "sha1", "merged commit"), 0),
        (F.substring(hexed, 1, 64), pick("sha256", "checksum", "digest of the file"), 0),
        (F.substring(hexed, 1, 32), pick("md5", "md5 checksum"), 0),
        (F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12)), pick("uuid", "guid", "session uuid"), 0),
        (F.concat(pick("password=", "token=", "secret=", "api_key="), pick("changeme1234", "your_password_here1", "example_token_123", "xxxxxxxxxxxx1", "placeholder123", "123456789012")), plain(), 0),
        (F.concat(F.lit('"'), pick("your-token-here-1", "example-secret-2", "xxxxxxxxxxxxxxxx0", "test_token_000000", "0000000000000000"), F.lit('"')), named_(), 0),
        (F.concat(pick("release", "version", "document", "table", "index"), F.substring(digits, 1, 4), pick("final", "build", "page", "report")), plain(), 0),
        (F.concat(F.lit("http://www."), F.substring(F.regexp_replace(hexed, "[0-9]", "e"), 1, 9), F.lit(".example.com/page/"), F.substring(digits, 1, 5)), plain(), 0),
        (F.concat(F.substring(F.regexp_replace(hexed, "[0-9]", "o"), 1, 6), F.lit("."), F.substring(digits, 1, 2), F.lit("@mail"), F.substring(digits, 3, 1), F.lit(".example.com")), plain(), 0),
        (F.concat(F.when(n % 2 == 0, '"').otherwise(pick("password=", "token:", "secret:", "pwd=")), phrase, F.when(n % 2 == 0, '"').otherwise("")),
         F.when(n % 2 == 0, pick("password:", "password =", "secret =", "token:", "api_key =")).otherwise(plain()), 1),
        (phrase, pick("the token", "your password", "secret", "token of", "password and the", "an auth", "keep secret"), 0),
        (F.concat(F.when(n % 2 == 0, '"').otherwise(pick("password=", "token:", "secret:", "pwd=")), blank, F.when(n % 2 == 0, '"').otherwise("")),
         F.when(n % 2 == 0, named_()).otherwise(plain()), 0),
        (F.concat(F.lit("-----BEGIN "), pick("", "RSA ", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----\n"), F.when(n % 4 > 0, F.concat(F.substring(many(8_500_000, 30), 1, 100 + (n % 7) * 200), F.lit("\n-----END PRIVATE KEY-----"))).otherwise("")), plain(), 1),
        (F.concat(F.lit("eyJ"), F.substring(url64(text), 1, 33), F.lit(".eyJ"), F.substring(url64(many(9_000_000, 16)), 1, 100 + (n % 7) * 90), F.lit("."),
                  F.substring(url64(many(9_500_000, 8)), 1, 43 + (n % 2) * 299)), pick("Authorization: Bearer", "jwt", "token =", "and then the", ""), 1),
        (F.substring(F.when(n % 2 == 0, many(8_000_000, 40)).otherwise(F.translate(many(8_000_000, 40), "+/=", "Qx")), 1, 300 + (n % 9) * 160), plain(), 0),
        (F.concat(F.lit('{"id":'), F.substring(digits, 1, 6), F.lit(',"rows":["'), F.array_join(F.transform(F.sequence(F.lit(1), 5 + n % 60), lambda k: F.concat(
            F.substring(hexed, (k % 50 + 1).cast("int"), F.lit(6)), F.lit('","name'), k.cast("string"))), '":"value'), F.lit('"]}')),
         F.when(n % 2 == 0, plain()).otherwise(pick('{"api_key":', '{"token":', '"password":')), 0),
        (F.concat(F.lit("https://www.example.com/find?"), F.array_join(F.transform(F.sequence(F.lit(1), 5 + n % 60), lambda k: F.concat(
            F.lit("page"), k.cast("string"), F.lit("="), F.substring(hexed, (k % 50 + 1).cast("int"), F.lit(7)))), "&")), plain(), 0),
        (F.concat(F.lit("2"), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 2), F.lit("-"), F.substring(digits, 6, 2), F.lit("T"), F.substring(digits, 8, 2), F.lit(":"), F.substring(digits, 10, 2)), plain(), 0),
        (F.concat(pick("stationerthing", "interalement", "gegenuberheit", "aquellamente"), F.substring(digits, 1, 2)), plain(), 0),
    ]
    made = spark.range(first, first + per_kind * len(kinds), 1, 1)
    rows = made.select("id", (n % len(kinds)).alias("kind"), hexed.alias("hexed"), text.alias("text"), size.alias("size"))
    word, before, label = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (w, b, lab) in enumerate(kinds):
        word, before, label = (F.when(F.col("kind") == i, x).otherwise(y) for x, y in ((w, word), (b, before), (F.lit(lab), label)))
    return rows.select(word.alias("word"), before.alias("before"), plain().alias("after"),
                       pick("src0", "src7", "app/settings", "deploy/values", "notes", "web").alias("path"), label.alias("label"))


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> PipelineModel:
    """Forest over the features of labelled findings (word, before, after, path, label); null labels are left out."""
    # Written first: generated or joined findings would otherwise be computed anew inside every feature.
    given = stage(findings.filter(F.col("label").isNotNull()).select("word", "before", "after", "path", "label"), "findings")
    rows = with_features(with_value(given)).select(*FEATURES, F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=2,
                                    featuresCol="_features", labelCol="label", probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_features"), forest]).fit(rows)


def scan(docs: DataFrame, model: PipelineModel, text: str = "text", key: str = "doc_id", path: str = "source",
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: ``doc_id``, ``place``, ``kind``, ``value``, ``score``, ``secret``.

    ``place`` is the word's number in the text from 0 (an empty first word counts), ``kind`` the vendor shape, ``assigned`` or ``generic``,
    ``score`` the forest's probability and ``secret`` whether it reaches the threshold. Null, empty and candidate-free texts give
    no row; a null path counts as harmless-free; repeated rows give theirs each; other columns are ignored.
    """
    kind = F.when(F.col("named").rlike(ASSIGNED) | F.col("before").rlike(ASSIGNED), "assigned").otherwise("generic")
    for name, shape in SHAPES.items():
        kind = F.when(F.col("value").rlike(f"^(?:{shape})$"), name).otherwise(kind)
    scored = model.transform(with_features(candidates(docs, text, key, path)))
    return scored.select("doc_id", "place", kind.alias("kind"), "value", F.element_at(vector_to_array("_probability"), 2).alias("score")).withColumn(
        "secret", F.col("score") >= threshold)


def redact(docs: DataFrame, model: PipelineModel, text: str = "text", path: str = "source", mask: str = "[secret]",
           threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every confirmed secret in ``text`` replaced by ``mask``, all other columns as they were.

    Every occurrence of a confirmed value is replaced in its document. Documents are matched to their findings by a digest of the whole
    row, so repeated rows and null ids are handled alike; documents without secrets keep their text to the letter.
    """
    kept = docs.columns
    body, words = named(text), F.struct(*map(named, kept))
    # Two hashes from different seeds: one alone would mix up rows of a very large corpus.
    row = F.struct(F.xxhash64(words).alias("a"), F.xxhash64(F.lit(1), words).alias("b"))
    suspect = F.coalesce(may_hold(body), F.lit(False))
    suspects = stage(docs.filter(suspect), "suspects")
    keyed = suspects.select(row.alias("_row"), body.alias("_text"), named(path).alias("_path") if path in kept else F.lit(None).cast("string").alias("_path"))
    values = (scan(keyed, model, "_text", "_row", "_path", threshold).filter("secret").groupBy(F.col("doc_id").alias("_row"))
              .agg(F.sort_array(F.collect_set(F.struct((-F.length("value")).alias("size"), "value"))).alias("_values")))
    masked = F.aggregate("_values", F.col("_text"), lambda t, v: F.replace(t, v["value"], F.lit(mask)))
    found = (suspects.select(row.alias("_row"), keep_columns(docs).alias("_doc"), body.alias("_text")).join(values, "_row", "left")
             .withColumn("_text", F.when(F.col("_values").isNull(), F.col("_text")).otherwise(masked))
             .select(*[F.col("_text").alias(c) if c == text else F.col("_doc")[c].alias(c) for c in kept]))
    # Texts that cannot hold one move nowhere.
    return docs.filter(~suspect).unionByName(found)
