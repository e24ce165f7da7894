"""Secrets in texts: candidate strings judged by a random forest, with DataFrame functions only.

A candidate is a run of 16 or more letters, digits and + / _ = - that holds both
a letter and a digit.  The forest sees its length, the transitions between kinds
of characters, the shares of digits, capitals and different characters, how much
of it dictionary words cover, whether it lies in a path, and the words next to
it.  It is trained from labelled findings to take out false positives.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import numbered, saved, sized

#: Trees, their depth, and the share of votes from which a candidate is a secret.
TREES, DEPTH, THRESHOLD = 30, 6, 0.5
MASK = "[SECRET]"
_RUN = r"[A-Za-z0-9+/_=\-]{16,}"
_WHITE = r"[ \t\n\x0B\f\r]+"

# Dictionary words and neighbouring words.
DICTIONARY = "account,admin,application,array,auth,backup,build,bucket,cache,class,client,cloud,code,column,common,config,content,core,data,date,default,demo,dist,docs,document,domain,dummy,error,event,example,file,folder,format,function,group,header,home,host,html,http,image,index,item,java,json,key,lib,line,link,list,local,login,main,model,module,name,node,number,object,offset,option,package,page,param,password,path,placeholder,plugin,prod,project,python,query,release,request,response,role,sample,schema,script,secret,section,server,service,session,source,stage,string,style,system,table,template,test,text,theme,time,title,token,type,update,user,usr,value,variable,version,view,web,window,your".split(",")
KEY_WORDS = r"(?i)(token|secret|passw|pwd|auth|bearer|credential|api.?key|access.?key|private.?key|\bkey)"
HASH_WORDS = r"(?i)(commit|sha\d*|md5|hash|digest|checksum|uuid|guid|\brev|etag|revision|fingerprint|\bid\b|tree|blob)"
MADE_UP = r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx|test|1234|0000|(.)\2{3})"

FEATURES = ["length", "transitions", "digits", "capitals", "different", "dictionary", "spoken", "in_path", "key_before", "hash_before", "key_after", "assigned", "quoted", "made_up", "hex_only"]


def _share(text: Column, pattern: str) -> Column:
    """Share of a string's characters that matches of a pattern cover."""
    return 1 - F.length(F.regexp_replace(text, pattern, "")) / F.length(text)


def candidates(texts: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each candidate in ``text``: the columns ``keep``, word (the number of its white-space word), secret (the candidate) and the features."""
    found = F.filter(F.regexp_extract_all("text", F.lit(f"({_RUN})"), F.lit(1)), lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]"))
    rows = texts.where(F.size(found) > 0).select(*keep, F.split("text", _WHITE).alias("words"))
    words = rows.select(*keep, "words", F.posexplode("words").alias("word", "here")).where(F.col("here").rlike(_RUN))

    def at(k: int) -> Column:
        return F.coalesce(F.try_element_at("words", F.col("word") + (k + 1)), F.lit(""))

    # An index of 0 isn't allowed, one below it counts from the end.
    before = [F.when(F.col("word") >= k, F.try_element_at("words", F.greatest(F.col("word") - k, F.lit(0)) + 1)).otherwise("") for k in (1, 2)]
    words = words.select(*keep, "word", "here", before[0].alias("last"), before[1].alias("last_but_one"), at(1).alias("next"))
    words = words.select("*", F.explode(F.regexp_extract_all("here", F.lit(f"({_RUN})"), F.lit(1))).alias("secret")).where(F.col("secret").rlike("[0-9]") & F.col("secret").rlike("[A-Za-z]"))
    s, size = F.col("secret"), F.length("secret")
    head = F.expr("substring_index(here, secret, 1)")
    said = F.concat_ws(" ", "last_but_one", "last", head)
    steps = F.length(F.regexp_replace(s, r"(?<=[a-z])(?=[0-9A-Z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9a-z])", " ")) - size
    features = {
        "length": size,
        "transitions": steps / size,
        "digits": _share(s, "[0-9]"),
        "capitals": _share(s, "[A-Z]"),
        "different": F.size(F.array_distinct(F.split(s, ""))) / size,
        "dictionary": _share(F.lower(s), "|".join(DICTIONARY)),
        "spoken": _share(F.lower(s), "[b-df-hj-np-tv-z]{0,2}[aeiouy]{1,2}[b-df-hj-np-tv-z]{1,2}[aeiouy]{1,2}[a-z]*"),
        "in_path": F.when(F.col("here").rlike(r"://|[\\@]|\.[a-z]{2,4}\b") | F.lower("here").rlike("^[\"'(]?/|(/[^/]*){2}"), 1).otherwise(0),
        "key_before": F.when(said.rlike(KEY_WORDS), 1).otherwise(0),
        "hash_before": F.when(said.rlike(HASH_WORDS), 1).otherwise(0),
        "key_after": F.when(F.col("next").rlike(KEY_WORDS), 1).otherwise(0),
        "assigned": F.when(head.rlike("[=:][\"'`]?$") | (head.rlike("^[\"'`]?$") & F.col("last").rlike("[=:]>?$")), 1).otherwise(0),
        "quoted": F.when(head.rlike("[\"'`]$"), 1).otherwise(0),
        "made_up": F.when(s.rlike(MADE_UP), 1).otherwise(0),
        "hex_only": F.when(s.rlike("^[0-9a-f]+$"), 1).otherwise(0),
    }
    return words.select(*keep, "word", "secret", *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in features.items()))


def example_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(text, is_secret): labelled findings made by rule, one candidate in each, for use where no reviewed ones are at hand."""
    sha = F.sha2(F.col("id").cast("string"), 256)
    other = F.sha2(F.concat(F.lit("o"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(sha)), "=+$", "")
    pick = F.pmod(F.xxhash64("id"), F.lit(1 << 20))

    def one_of(*words: str) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (pick % len(words)).cast("int") + 1)

    quote = one_of('"', "'", "", '"')
    key = one_of("token", "secret", "api_key", "password", "access_token", "auth_token", "SECRET_KEY", "client_secret", "private_key", "credential")
    sign = one_of(" = ", "=", ": ", " := ", '": ')
    word = one_of("thing", "of the", "when", "la casa", "und das", "report", "value was")
    hexes = F.substring(sha, 1, F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3))).cast("int") + 1))
    texts = [
        (F.concat(key, sign, quote, hexes, quote), 1),
        (F.concat(key, F.lit(" = "), quote, F.substring(sha, 1, 40), quote), 1),
        (F.concat(key, sign, quote, b64, quote), 1),
        (F.concat(F.lit("aws id"), sign, F.lit("AKIA"), F.upper(F.translate(F.substring(sha, 1, 16), "01", "QZ"))), 1),
        (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "x"), 1, 36)), 1),
        (F.concat(F.lit("Authorization: Bearer "), F.substring(b64, 1, 40)), 1),
        (F.concat(key, sign, quote, F.substring(b64, 1, 20), quote), 1),
        (F.concat(one_of("commit ", "tree ", "revision ", "sha1 ", "blob "), F.substring(sha, 1, 40)), 0),
        (F.concat(one_of("sha256:", "checksum = ", "digest: ", "md5 ", "etag: "), quote, hexes, quote), 0),
        (F.concat(one_of("id = ", "uuid: ", "guid ", "request id "), F.substring(sha, 1, 8), F.lit("-"), F.substring(sha, 9, 4), F.lit("-4"), F.substring(sha, 13, 3), F.lit("-a"), F.substring(sha, 16, 3), F.lit("-"), F.substring(other, 1, 12)), 0),
        (F.concat(F.lit("/usr/lib/python3/"), one_of("config", "data", "model"), F.lit("/template-"), F.substring(sha, 1, 2), F.lit("/version-"), (pick % 97).cast("string")), 0),
        (F.concat(key, sign, quote, one_of("your-token-goes-here-1", "example-secret-key-123", "xxxxxxxxxxxxxxxxxxx1", "placeholder_value_00", "changeme-changeme-12", "test_token_for_docs_1"), quote), 0),
        (F.concat(one_of("class_", "function_", "session_index_", "default_param_"), one_of("user_", "page_", "table_"), one_of("name_", "offset_", "column_"), (pick % 997).cast("string")), 0),
        (F.concat(F.lit("https://example.org/docs/page-"), F.substring(sha, 1, 24), F.lit(".html")), 0),
        (F.concat(F.lit("photo "), (20000000 + pick % 9999).cast("string"), F.lit("-img-"), (pick % 9973).cast("string"), F.lit("-large")), 0),
        (F.concat(one_of("Donaudampfschiff", "internationalisation", "responsabilidades", "anticonstitutionnel"), (pick % 97).cast("string")), 0),
    ]
    kinds = F.array(*(F.struct(t.alias("text"), F.lit(label).alias("is_secret")) for t, label in texts))
    chosen = spark.range(rows).withColumn("kind", F.element_at(kinds, (F.col("id") % len(texts)).cast("int") + 1))
    return chosen.select(F.concat_ws(" ", word, F.col("kind.text"), one_of("and", "then", "der", "que")).alias("text"), F.col("kind.is_secret").cast("double").alias("is_secret"))


def train(labelled: DataFrame, seed: int = 5) -> RandomForestClassificationModel:
    """A forest from labelled findings (text, is_secret 0 or 1); every candidate of a text has its label.  Nulls are left out."""
    rows = candidates(labelled.where("text is not null and is_secret is not null").withColumn("is_secret", F.col("is_secret").cast("double")), ["is_secret"])
    forest = RandomForestClassifier(featuresCol="features", labelCol="is_secret", numTrees=TREES, maxDepth=DEPTH, seed=seed, maxBins=32)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def judged(texts: DataFrame, keep: list[str], model: RandomForestClassificationModel) -> DataFrame:
    """Every candidate with ``confidence``, the forest's share of votes that it is a secret."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(candidates(texts, keep))
    return model.transform(rows).select(*keep, "word", "secret", vector_to_array("probability")[1].alias("confidence"))


def secrets(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """(doc_id, word, secret, confidence) of every secret in ``docs`` (doc_id, text; other columns are ignored).

    word is the number of the white-space word, from 0, that holds the secret.
    Null and empty texts have none.  Repeated rows repeat their findings; rows
    without doc_id keep a null one.
    """
    model = model or train(example_findings(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judged(rows, ["doc_id"], model).where(F.col("confidence") >= THRESHOLD)


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with each secret of ``found`` (doc_id, secret) replaced by ``MASK`` in the text of its row, and n_chars, if there, counted anew; other columns stay, whatever their names."""
    lists = saved(found.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_set("secret"), asc=False).alias("secrets")), "secrets")
    plain, names = numbered(docs)
    doc_id, text = (plain[f"c{names.index(c)}"] for c in ("doc_id", "text"))
    rows = plain.join(sized(lists), doc_id.eqNullSafe(F.col("id")), "left")
    listed = F.col("secrets").isNotNull()
    hidden = F.when(listed, F.aggregate("secrets", text, lambda t, s: F.replace(t, s, F.lit(MASK)))).otherwise(text)
    new = {"text": hidden}
    if "n_chars" in names:
        n = plain[f"c{names.index('n_chars')}"]
        new["n_chars"] = F.when(listed, F.length(hidden).cast(docs.schema["n_chars"].dataType)).otherwise(n)
    return rows.select(*(new.get(c, plain[f"c{k}"]).alias(f"c{k}") for k, c in enumerate(names))).toDF(*names)
