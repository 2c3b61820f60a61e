import pytest
from pyspark.sql import functions as F

from mapweave.functions.framings import FRAMINGS
from mapweave.functions import hygiene as hy
from mapweave.operators import formulation
from mapweave.sources import bulk, bulk_write, payloads
from mapweave.streaming.dedup import unseen_results


def test_bulk_csv_round_trip(spark, tmp_path):
    path = tmp_path / "bulk.csv"
    path.write_text('query,max_results,tld_filter,search_engine\nclimate ,5,.dk|.com,Serper\n"",200,dk,other\nx,ten,,\n')
    rows = bulk.validate(bulk.read_bulk_csv(spark, str(path))).collect()
    assert rows[0]["errors"] == []
    assert len(rows[1]["errors"]) == 4
    assert rows[2]["errors"] == ["max_results must be a number"]
    good = bulk.normalize(bulk.read_bulk_csv(spark, str(path))).first()
    assert (good["query"], good["framing"], good["language"], good["max_results"], good["search_engine"], good["tld_filter"]) == (
        "climate", "neutral", "en", 5, "serper", [".dk", ".com"])
    (tmp_path / "bad.csv").write_text("term\nx\n")
    with pytest.raises(ValueError):
        bulk.read_bulk_csv(spark, str(tmp_path / "bad.csv"))


def test_payload_variants(spark):
    pages = spark.createDataFrame(
        [(1, 1, '{"organic":[{"link":"https://a.com/","title":"A"},{"link":"","title":"B"},{"title":"C"}]}'),
         (1, 2, '{"organic":[{"link":"https://d.com/","title":"D","snippet":"s"},{"link":"https://e.com/","title":"E"}]}'),
         (2, 1, '{"other":1}'), (3, 1, "broken")], "q int, page int, payload string")
    got = payloads.parse_contiguous(pages, ["q"], "page", "payload", 2).orderBy("rank").collect()
    assert [(r["rank"], r["url"], r["domain"]) for r in got] == [(1, "https://a.com/", "a.com"), (2, "https://d.com/", "d.com")]
    items = pages.withColumn("payload", F.replace("payload", F.lit("organic"), F.lit("items")))
    assert [r["rank"] for r in payloads.parse_paged(items, ["q"], "page", "payload").orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    one = spark.createDataFrame(
        [(1, '{"organic_results":[{"link":"","url":"https://x.com"},{"title":"gap"},{"link":"https://y.com","description":"d"}]}')],
        "q int, payload string")
    got = payloads.parse_positional(one, ["q"], "payload").orderBy("rank").collect()
    assert [(r["rank"], r["url"], r["description"]) for r in got] == [(1, "https://x.com", ""), (3, "https://y.com", "d")]


def test_bulk_writes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, version int")
    assert sorted(tuple(r) for r in bulk_write.upsert(table, new, ["id"], ["version"]).collect()) == [(1, "a"), (2, "y"), (3, "z")]
    change = spark.createDataFrame([(2, None)], "id int, v string")
    assert sorted(tuple(r) for r in bulk_write.update(table, change).collect()) == [(1, "a"), (2, None)]
    assert bulk_write.delete(table, change).count() == 1


def test_masks(spark):
    df = spark.createDataFrame([("ab@x.org",), ("alice@x.org",), ("nobody",)], "e string")
    assert [r[0] for r in df.select(hy.mask_email("e")).collect()] == ["a*@x.org", "a***e@x.org", "nobody"]
    row = spark.range(1).select(
        hy.mask_string(F.lit("1234567890")).alias("a"), hy.mask_string(F.lit("short")).alias("b"),
        hy.truncate_text(F.lit("abcdefgh"), 5).alias("c"), hy.clean_url(F.lit(" JAVASCRIPT:x ")).alias("d"),
        hy.clean_url(F.lit("ex.com/?a=1&b")).alias("e"), hy.escape_html(F.lit("<a href='x'>&\"")).alias("f"),
    ).first()
    assert tuple(row) == (
        "1234**7890", "*****", "ab...", "", "https://ex.com/?a=1&amp;b", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;")


def test_redaction_reaches_nested_fields(spark):
    df = spark.sql("SELECT 1 AS id, 'p' AS user_password, named_struct('api_key', 'k', 'n', array(named_struct('token', 't', 'x', 2))) AS s, map('Secret', 'a', 'b', 'c') AS m")
    row = hy.redact(df).first()
    assert row["user_password"] == hy.REDACTED and row["s"]["api_key"] == hy.REDACTED
    assert row["s"]["n"][0]["token"] == hy.REDACTED and row["s"]["n"][0]["x"] == 2
    assert row["m"] == {"Secret": hy.REDACTED, "b": "c"}


def test_redaction_reaches_every_nested_type(spark):
    df = spark.sql("""SELECT array(map('password', 'p', 'a', 'b')) AS am, map('x', named_struct('token', 't', 'n', 1)) AS ms,
        map('x', map('secret', 's', 'y', 'z')) AS mm, map('password', named_struct('n', 1)) AS mp, map('k', array(map('api_key', 'q'))) AS mam,
        map('n', 1, 'token', 2) AS mi, array(array(named_struct('secret', 's', 'v', 1))) AS aa""")
    row = hy.redact(df).first()
    assert row["am"] == [{"password": hy.REDACTED, "a": "b"}]
    assert row["ms"]["x"]["token"] == hy.REDACTED and row["ms"]["x"]["n"] == 1
    assert row["mm"] == {"x": {"secret": hy.REDACTED, "y": "z"}}
    assert row["mp"] == {"password": None}
    assert row["mam"] == {"k": [{"api_key": hy.REDACTED}]}
    assert row["mi"] == {"n": 1, "token": None}
    assert row["aa"][0][0]["secret"] == hy.REDACTED and row["aa"][0][0]["v"] == 1


def test_templates(spark):
    issues = spark.createDataFrame([("climate", "da", None, "2020"), ("tax", "xx", "Paris", None)],
                                   "issue string, language string, location string, year string")
    rows = formulation.expand_framings(issues, ["local", "temporal"]).collect()
    by_issue = {}
    for r in rows:
        by_issue.setdefault(r["issue"], []).append(r["query"])
    assert sorted(by_issue["climate"]) == ["climate 2020", "climate historie", "climate tidslinje", "fremtid for climate"]
    assert len(by_issue["tax"]) == 3 + 3 and "tax in Paris" in by_issue["tax"]
    sizes = {lang: {k: len(v) for k, v in kinds.items()} for lang, kinds in FRAMINGS.items()}
    assert sizes["en"] == {"neutral": 3, "activist": 5, "skeptic": 5, "scientific": 5, "policy": 5, "industry": 5, "media": 4, "local": 3, "temporal": 4}
    assert sizes["da"] == {"neutral": 3, "activist": 5, "skeptic": 4, "scientific": 4, "policy": 4, "industry": 4, "media": 3, "local": 3, "temporal": 4}
    row = spark.range(1).select(
        formulation.apply_template(F.lit("{a} or {b}"), F.create_map(F.lit("a"), F.lit("x"))).alias("r"),
        formulation.translate(F.lit("climate crisis"), "en", "da").alias("t")).first()
    assert row["r"]["query"] is None and row["r"]["error"] == "Missing required variables: b"
    assert row["t"] == "klimakrise"


def test_stream_drops_seen_urls(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "session_id bigint, url string, created_at timestamp"
    rows = [[(1, "https://A.com/x/", "2024-01-01 00:00:00"), (1, "https://a.com/x#f", "2024-01-01 00:01:00"),
             (2, "https://a.com/x", "2024-01-01 00:02:00")],
            [(1, "https://a.com/x", "2024-01-01 00:03:00"), (1, "https://a.com/y", "2024-01-01 00:04:00")]]
    for batch in rows:
        df = spark.createDataFrame(batch, "session_id bigint, url string, t string")
        df.select("session_id", "url", F.to_timestamp("t").alias("created_at")).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = (unseen_results(stream).writeStream.format("parquet").option("path", str(out))
                 .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        query.awaitTermination()
    got = spark.read.parquet(str(out)).select("session_id", "url_hash").collect()
    assert len(got) == 3 and len({tuple(r) for r in got}) == 3
