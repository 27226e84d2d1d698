import datetime as dt
import io
import json
import zipfile

from liame.sources import feeds
from liame.streaming import ingest

RSS = """<?xml version="1.0" encoding="ISO-8859-1"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<item><title>Ana fala - Jornal X</title><link> https://www.site.com.br/a </link><pubDate>Mon, 31 Aug 2026 09:00:00 -0300</pubDate><source url="https://jornalx.com.br">Jornal X</source>
<description>curto</description><content:encoded><![CDATA[<p>Corpo da not&iacute;cia.</p><h3>Leia mais</h3><ul><li>Outra</li></ul><p>Fim.</p>]]></content:encoded></item>
<item><title>sem link</title></item></channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(RSS.encode("latin-1"))
    (tmp_path / "b.xml").write_text("no feed")
    rows = feeds.rss(spark, str(tmp_path)).collect()
    assert [(r["uri"], r["text"], r["published_at"], r["domain"]) for r in rows] == [("https://www.site.com.br/a", "Ana fala . Corpo da notícia. Fim.", dt.datetime(2026, 8, 31, 12), "jornalx.com.br")]


def test_body_drops_marked_lists():
    assert feeds.body_text("Um.<br>Saiba mais:<br>Outra historia<br>Dois fim.<br>Leia mais: x y") == "Um. Dois fim."


def archive(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", text)
    return out.getvalue()


def test_bounded_unzip():
    assert feeds.bounded_unzip(archive("abc"), 3) == ("ok", "abc") and feeds.bounded_unzip(archive("abcd"), 3)[0] == "oversize" and feeds.bounded_unzip(b"x")[0] == "reject"


def test_events(spark, tmp_path):
    cells = [""] * 27
    for k, v in {3: "WWW.a.com.br", 4: "http://a/1", 11: "ana lima;rui", 13: "Câmara;camara", 15: "-2.5,1", 25: "srclc:por;eng", 26: "<PAGE_TITLE>Ol&aacute;</PAGE_TITLE>"}.items():
        cells[k] = v
    (tmp_path / "20260831091500.zip").write_bytes(archive("\t".join(cells) + "\n" + "\t".join(cells[:20]) + "srclc:por\n"))
    r = feeds.events(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0]["text"], r[0]["domain"], r[0]["tone"], r[0]["extra_names"]) == ("Olá", "a.com.br", -2.5, ["ana lima", "rui"])
    assert [x["term"] for x in r[0]["extra_terms"]] == ["camara"] and r[0]["published_at"] == dt.datetime(2026, 8, 31, 9, 15)


def test_stream_merges_and_replays(spark, tmp_path):
    schema = "doc_id long, source string, uri string, text string, published_at timestamp_ntz, collected_at timestamp_ntz, domain string, country string, tone double, reach_likes int, reach_reposts int, reach_replies int, reach_quotes int"
    persons = spark.createDataFrame([("ana", ["Ana Lima"])], "id string, aliases array<string>")
    land, store, ckpt = (str(tmp_path / x) for x in ("land", "store", "ckpt"))
    (tmp_path / "land").mkdir()

    def put(name, rows):
        (tmp_path / "land" / name).write_text("\n".join(json.dumps({"source": "rss", "published_at": "2026-08-30 00:00:00", **r}) for r in rows))

    put("1.json", [{"doc_id": 1, "uri": "u", "text": "Ana Lima", "collected_at": "2026-08-30 01:00:00"}, {"doc_id": 2, "uri": "v", "text": "ninguem", "collected_at": "2026-08-30 01:00:00"}])
    for _ in range(2):
        q = ingest.stream(spark, land, schema, persons, store, ckpt, ["doc_id"])
        q.awaitTermination()
        put("2.json", [{"doc_id": 3, "uri": "u", "text": "Ana Lima de novo", "collected_at": "2026-08-30 02:00:00"}])
    table = ingest.Store(spark, store)
    assert [(r["doc_id"], r["uri"], r["text"]) for r in table.read().collect()] == [(1, "u", "Ana Lima de novo")]
    assert len(table.numbers()) == 2 and spark.read.parquet(f"{store}/ledger").count() == 2
    # A batch that dies before its manifest is in place changes nothing, and its replay leaves the same table.
    fs, last = table._fs, table.numbers()[-1]
    fs.delete(table._at(f"manifests/{last}"), False)
    assert [r["text"] for r in table.read().collect()] == ["Ana Lima"]
    (tmp_path / "ckpt" / "commits" / str(last // 2)).unlink()
    for crc in (tmp_path / "ckpt" / "commits").glob(f".{last // 2}.crc"):
        crc.unlink()
    ingest.stream(spark, land, schema, persons, store, ckpt, ["doc_id"]).awaitTermination()
    assert [r["text"] for r in table.read().collect()] == ["Ana Lima de novo"]
    put("3.json", [{"doc_id": 4, "uri": "w", "text": "Ana Lima", "collected_at": "2026-08-30 03:00:00"}, {"doc_id": None, "uri": "x", "text": "Ana Lima"}, {"doc_id": 6, "uri": None, "text": "Ana Lima"}])
    (tmp_path / "land" / "4.json").write_text("nicht JSON")
    ingest.stream(spark, land, schema, persons, store, ckpt, ["doc_id"]).awaitTermination()
    assert sorted(r["uri"] for r in table.read().collect()) == ["u", "w"]
    assert sorted(r["reason"] for r in spark.read.parquet(f"{store}/rejected").collect()) == ["no address", "no document", "no id"]
    before = sorted(map(tuple, table.read().select("doc_id", "uri", "text").collect()))
    table.compact()
    assert sorted(map(tuple, table.read().select("doc_id", "uri", "text").collect())) == before and len(list((tmp_path / "store" / "data").iterdir())) == 1
    put("5.json", [{"doc_id": 9, "uri": "w", "text": "Ana Lima outra vez", "collected_at": "2026-08-30 04:00:00"}])
    ingest.stream(spark, land, schema, persons, store, ckpt, ["doc_id"]).awaitTermination()
    assert sorted((r["uri"], r["text"]) for r in table.read().collect()) == [("u", "Ana Lima de novo"), ("w", "Ana Lima outra vez")]


def test_collectors_keep_the_rest_of_a_page(spark, tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(json.dumps(value) if not isinstance(value, str) else value)
    for d in ("blog", "house", "senate", "index", "views"):
        (tmp_path / d).mkdir()
    put("blog/1.json", {"posts": [{"uri": "at://1", "record": {"text": "oi", "createdAt": "2026-08-30T10:00:00Z"}, "author": {"handle": "a.example"}, "likeCount": 3}, {"uri": 5}, "falsch", {"record": {}}]})
    put("blog/2.json", "kein JSON")
    rows = feeds.collect(spark, "bluesky", str(tmp_path / "blog")).collect()
    assert [(r["text"], r["domain"], r["reach_likes"], r["reach_quotes"], str(r["published_at"])) for r in rows if r["uri"] == "at://1"] == [("oi", "a.example", 3, None, "2026-08-30 10:00:00")]
    put("house/1.json", {"dados": [{"dataHoraInicio": "2026-08-30T10:00", "sumario": "fala  longa"}, {"sumario": "sem hora"}, {"dataHoraInicio": "2026-08-30T10:00:00Z", "urlTexto": "http://t"}]})
    rows = {r["uri"]: r for r in feeds.collect(spark, "camara", str(tmp_path / "house"), person="Ana", member="7").collect()}
    assert len(rows) == 2 and rows["http://t"]["text"] == "Ana:" and str(rows["http://t"]["published_at"]) == "2026-08-30 10:00:00"
    own = next(r for u, r in rows.items() if u.endswith("/7/2026-08-30T10:00"))
    assert own["text"] == "Ana: fala longa" and str(own["published_at"]) == "2026-08-30 13:00:00"
    put("senate/1.json", {"DiscursosParlamentar": {"Parlamentar": {"Pronunciamentos": {"Pronunciamento": {"UrlTexto": "http://s", "TextoResumo": "x", "DataPronunciamento": "2026-08-30"}}}}})
    assert [(r["uri"], r["text"]) for r in feeds.collect(spark, "senado", str(tmp_path / "senate"), person="Ana").collect()] == [("http://s", "Ana: x")]
    put("index/1.json", {"articles": [{"url": "http://g", "title": "T - 30 / 08 / 2026 x", "seendate": "20260830T101500Z", "domain": "A.br"}]})
    r = feeds.collect(spark, "gdelt", str(tmp_path / "index")).first()
    assert (r["text"], r["domain"], r["published_at"]) == ("T", "a.br", dt.datetime(2026, 8, 30, 10, 15))
    put("views/1.json", {"items": [{"timestamp": "2026083000", "views": 4}, {"timestamp": "2026083000", "views": 5}, {"timestamp": "2026133000", "views": 5}, {"timestamp": "2026083100", "views": -1}]})
    got = ingest.latest_views(feeds.page_views(spark, str(tmp_path / "views"), "ana")).collect()
    assert [(str(r["day"]), r["views"]) for r in got] == [("2026-08-30", 5)]
    assert feeds.slots("20260831233000", "20260901000000") == ["20260831233000", "20260831234500", "20260901000000"]


def test_feeds_that_cannot_be_read_are_told(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<!DOCTYPE rss SYSTEM "x.dtd"><rss><channel><item><title>A</title><link>http://a</link></item></channel></rss>')
    (tmp_path / "b.xml").write_text("no feed")
    (tmp_path / "c.xml").write_text('<!DOCTYPE rss [<!ENTITY a "b">]><rss/>')
    assert [r["uri"] for r in feeds.rss(spark, str(tmp_path)).collect()] == ["http://a"]
    assert sorted(r["path"][-5:] for r in feeds.rejected_feeds(spark, str(tmp_path)).collect()) == ["b.xml", "c.xml"]


def test_persons_upsert_and_prune(spark):
    stored = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    incoming = spark.createDataFrame([("b", "B2", 1), ("b", "B3", 2), ("c", "C", 1)], "id string, name string, seq int")
    assert sorted(map(tuple, ingest.upsert_persons(stored, incoming).collect())) == [("a", "A"), ("b", "B3"), ("c", "C")]
    persons, links = ingest.pruned(stored, spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, person_id string"), spark.createDataFrame([("a",)], "id string"))
    assert persons.count() == 1 and [tuple(r) for r in links.select("doc_id", "person_id").collect()] == [(1, "a")]
