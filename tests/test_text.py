import datetime as dt
import hashlib

from pyspark.sql import functions as F

from codefacts.functions import keys, labels, text


def one(spark, column, **values):
    cells = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cells).select(column).first()[0]


def test_truncation(spark):
    t = F.col("t")
    assert one(spark, text.truncate_marked(t, 100), t="hello") == "hello"
    assert one(spark, text.truncate_marked(t, 100), t="a" * 200) == "a" * 100 + "\n\n[...truncated, 200 chars total]"
    assert one(spark, text.title(t), t="word " * 50) == " ".join(["word"] * 9) + "..."
    assert one(spark, text.title(t), t="x" * 50) == "x" * 50
    assert one(spark, text.preview(t), t="y" * 51) == "y" * 50 + "..."
    assert one(spark, text.truncate_omitted(t, 3), t="abcdef") == "abc\n... [TRUNCATED — 3 chars omitted]"
    assert one(spark, text.truncate_json(F.nullif(F.struct(t), F.struct(t)), 3), t="a") == "N/A"


def test_context_and_title_json(spark):
    c = text.parse_context(F.col("t"), F.col("r"))
    tagged = "[Context: a/b.java > add(int)]  why\nso?"
    assert tuple(one(spark, c, t=tagged, r="human")) == ("why\nso?", "a/b.java", "add(int)")
    assert tuple(one(spark, c, t=tagged, r="ai")) == (tagged, None, None)
    s = text.strip_title(F.col("t"), F.col("r"))
    assert one(spark, s, t='answer \n {"title" : "x y"} ', r="ai") == "answer"
    assert one(spark, s, t='answer {"title":"x"}', r="user") == 'answer {"title":"x"}'
    assert one(spark, text.norm_role(F.col("r")), r="tool") == "assistant"


def test_age(spark):
    now = dt.datetime(2024, 2, 1)
    expected = {4: (0, "now"), 5: (5, "second"), 60: (1, "minute"), 3600: (1, "hour"), 86400 * 6: (6, "day"),
                86400 * 7: (1, "week"), 86400 * 31: (1, "month"), 86400 * 400: (1, "year")}
    for seconds, want in expected.items():
        got = one(spark, text.age_bucket(F.col("t"), F.col("n")), t=now - dt.timedelta(seconds=seconds), n=now)
        assert tuple(got) == want, seconds


def test_keys(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    none = F.lit(None).cast("string")
    assert one(spark, keys.user_key(F.lit("t"), F.lit("o"), F.lit("i"), F.lit("s")), t="") == sha("azure:t:o")
    assert one(spark, keys.user_key(none, none, F.lit("issuer"), F.lit("sub")), t="") == sha("oidc:issuer:sub")
    assert one(spark, keys.chunk_id(F.lit("r"), F.lit("p"), F.lit(3)), t="") == sha("r:p:3")
    digest = hashlib.sha1(b"return x").hexdigest()[:8]
    assert one(spark, keys.stmt_key(F.lit("p"), F.lit(4), F.lit("ReturnStatement"), F.lit("return x")), t="") == f"stmt:p:4:returnstatement:{digest}"
    assert one(spark, keys.fqn(none, F.lit("A")), t="") == "A"


def test_labels(spark):
    scope = lambda s: one(spark, labels.scope_label(F.col("s")), s=s)
    assert scope("method:a.b.C#m(x.Y):int") == "C#m(x.Y):int"
    assert scope("a.b.C#m(a#b)") == "C#m(a#b)" and scope("type:a.B") == "a.B" and scope("") == "(global)"
    old = F.create_map(F.lit("return_type"), F.lit("int"))
    new = F.create_map(F.lit("return_type"), F.lit("int"), F.lit("return_type_fqn"), F.lit("int"))
    assert one(spark, labels.is_legacy_method(old), t="") and not one(spark, labels.is_legacy_method(new), t="")
