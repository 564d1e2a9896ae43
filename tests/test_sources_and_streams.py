import io
import json
import zipfile

import pytest

from atlaskb import jobs, schemas
from atlaskb.__main__ import main
from atlaskb.config import Settings
from atlaskb.sources import fetch, readers
from atlaskb.streaming import streams


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_index_state_and_rules(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"pages": [{"url": "a", "title": "A", "file": "f"}], "pdfs": [{"url": "p", "file": "g"}]}))
    pages, pdfs = readers.read_index(spark, str(tmp_path / "index.json"))
    assert pages.first().title == "A" and pdfs.first().url == "p"
    (tmp_path / "state.json").write_text(json.dumps({"a": {"hash": "1", "changed": True}}))
    assert readers.read_state(spark, str(tmp_path / "state.json")).first().hash == "1"
    (tmp_path / "broken.json").write_text("{")
    assert readers.read_state(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "offices.json").write_text(json.dumps([{"keywords": ["k"], "name": "N", "path": "/p"}, {"keywords": [], "name": "M", "url": "u"}]))
    assert [r.url for r in readers.read_offices(spark, str(tmp_path / "offices.json"), Settings(site_url="https://s/")).orderBy("ord").collect()] == ["https://s/p", "u"]
    (tmp_path / "synonyms.json").write_text(json.dumps({"b": ["x"], "a": ["y", "z"]}))
    assert [r.term for r in readers.read_synonyms(spark, str(tmp_path / "synonyms.json")).orderBy("ord").collect()] == ["b", "a"]
    (tmp_path / "facts.json").write_text(json.dumps([{"keywords": ["k"], "text": "t", "title": "T", "source": "src"}, {"keywords": ["k"], "require_any": ["r"], "text": "t", "title": "T", "source_path": "/q"}]))
    got = readers.read_facts(spark, str(tmp_path / "facts.json"), Settings(site_url="https://s")).orderBy("ord").collect()
    assert [(r.source, r.require_any, r.category) for r in got] == [("src", ["k"], "pagina"), ("https://s/q", ["r"], "pagina")]


def test_logs_skip_malformed_lines(spark, tmp_path):
    (tmp_path / "gaps.jsonl").write_text('{"ts": "1", "query": "q", "chunks": 0}\nnot json\n\n{"ts": "2", "query": "r", "chunks": 1}\n')
    assert readers.read_log(spark, str(tmp_path / "gaps.jsonl"), schemas.GAP).count() == 2
    readers.append_log(spark.createDataFrame([("3", "s", 0)], schemas.GAP), str(tmp_path / "log"))
    readers.append_log(spark.createDataFrame([("4", "s", 0)], schemas.GAP), str(tmp_path / "log"))
    assert readers.read_log(spark, str(tmp_path / "log"), schemas.GAP).count() == 2
    (tmp_path / "sync.log").write_text("x\n[HTML 1/2]\nVector store caricato: 3 chunk\n")
    assert readers.read_sync_log(spark, str(tmp_path / "sync.log")).count() == 2


def test_inbox(spark, tmp_path):
    long = "città " * 30
    (tmp_path / "a.txt").write_text(long)
    (tmp_path / "b.TXT").write_bytes(long.encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(docx(long, " ", "end"))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.png").write_bytes(b"x")
    (tmp_path / "f.txt").write_text("short")
    files = readers.list_inbox(spark, str(tmp_path))
    texts = {r.file: r for r in readers.inbox_texts(files).collect()}
    assert set(texts) == {"a.txt", "b.TXT", "c.docx", "d.docx", "f.txt"}
    assert texts["a.txt"].text == texts["b.TXT"].text == long and texts["c.docx"].text == f"{long}\n\nend" and texts["d.docx"].error
    sidecars = spark.createDataFrame([("a", "Title", None, "avviso")], "stem string, title string, source_url string, category string")
    got = {r.filename: r for r in readers.with_sidecars(readers.inbox_texts(files), sidecars).collect()}
    assert set(got) == {"a.txt", "b.TXT", "c.docx"}
    assert (got["a.txt"].title, got["a.txt"].source, got["a.txt"].category) == ("Title", "file://a.txt", "avviso")
    assert (got["c.docx"].title, got["c.docx"].category) == ("c", "documento")


def test_snapshots_can_be_rewritten_from_themselves(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "a int"
    assert readers.read_snapshot(spark, root, schema).count() == 0
    for n in range(1, 5):
        df = readers.read_snapshot(spark, root, schema).unionByName(spark.createDataFrame([(n,)], schema))
        readers.write_snapshot(df, root, keep=2)
        assert readers.read_snapshot(spark, root, schema).count() == n
    assert readers.snapshot_versions(spark, root) == [3, 4]


def test_site_source(spark):
    spark.dataSource.register(fetch.SiteSource)
    rows = spark.read.format("site").option("urls", "text:<p>hi</p>\ntext:x").option("fetcher", "text").option("delay", "0").option("partitions", "2").load().collect()
    assert {bytes(r.body) for r in rows} == {b"<p>hi</p>", b"x"}
    bad = spark.read.format("site").option("urls", "u").option("fetcher", "nosuch").load().first()
    assert bad.body is None and "KeyError" in bad.error


def test_stream_inbox(spark, tmp_path):
    inbox, seen, rejected = tmp_path / "in", [], []
    inbox.mkdir()
    (inbox / "a.txt").write_text("word " * 40)
    (inbox / "b.txt").write_text("short")
    empty = lambda: spark.createDataFrame([], "stem string, title string, source_url string, category string")
    run = lambda: streams.run_inbox(streams.inbox(spark, str(inbox)), empty, lambda d: seen.extend(r.filename for r in d.collect()), lambda d: rejected.extend(r.path for r in d.collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    run()
    run()
    assert seen == ["a.txt"] and len(rejected) == 1


def test_stream_state_emits_changes_only(spark, tmp_path):
    kind, seen = "url string, html string, title string, file string", []
    source = tmp_path / "pages"
    add = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(kind).parquet(str(source))
        streams.run_crawl_state(stream, str(tmp_path / "state"), lambda d: seen.append(sorted(r.url for r in d.collect())), str(tmp_path / "cp"), lambda: "now").awaitTermination()

    add([("a", "1", "t", "f"), ("b", "1", "t", "f")])
    run()
    add([("a", "1", "t", "f"), ("b", "2", "t", "f"), ("c", "1", "t", "f")])
    run()
    assert seen == [["a", "b"], ["b", "c"]]
    state = {r.url: r.changed for r in readers.read_snapshot(spark, str(tmp_path / "state"), schemas.STATE).collect()}
    assert state == {"a": False, "b": True, "c": True}


@pytest.mark.parametrize("late", ["2 hours"])
def test_stream_hours_and_cache(spark, tmp_path, late):
    events = spark.createDataFrame([("2024-01-01 00:10:00", 1, "x"), ("2024-01-01 00:50:00", 1, "x"), ("2024-01-01 05:00:00", 1, "x")], "ts string, user_id long, event_type string").selectExpr("to_timestamp(ts) AS ts", "user_id", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = streams.over_limit(stream, 1, late=late).writeStream.format("memory").queryName("over").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.n for r in spark.table("over").collect()] == [2]
    requests = spark.createDataFrame([(0, i, k) for i, k in enumerate("abacba")], "shard int, seq long, key string")
    requests.coalesce(1).write.parquet(str(tmp_path / "rq"))
    cached = streams.cache_stream(spark.readStream.schema(requests.schema).parquet(str(tmp_path / "rq")), 2)
    cached.writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [r.hit for r in spark.table("hits").orderBy("seq").collect()] == [False, False, True, False, False, False]
    out = streams.append_stream(spark.readStream.schema(requests.schema).parquet(str(tmp_path / "rq")), str(tmp_path / "out"), str(tmp_path / "cp2"))
    out.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_sync_log_is_numbered_by_file_and_place(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "sync-1.log").write_text("".join(f"2024-01-0{i} 00:00:00,000 [INFO] [HTML {i}/9]\n" for i in (1, 2, 3)))
    (logs / "sync-2.log").write_text("".join(f"2024-02-01 00:00:00,000 [INFO] {'[PDF ' if i % 2 else 'noise '}{i}/9]\n" for i in range(3000)))
    rows = readers.read_sync_log(spark, str(logs)).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [0, 1, 2, *range(4, 3003, 2)] and rows[0].line.startswith("2024-01-01") and rows[3].line.endswith("[PDF 1/9]")


def test_inbox_job_sorts_and_moves(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "b.txt").write_text("A sentence of some words that say little. " * 5)
    (inbox / "b.json").write_text(json.dumps({"title": "Title", "category": "avviso"}))
    (inbox / "a.txt").write_text("short")
    (inbox / "c.docx").write_bytes(b"broken")
    base = jobs.Base(spark, str(tmp_path / "base"), Settings(embedding_dim=8))
    told = jobs.take_inbox(base, str(inbox))
    assert [(r.file, r.ok) for r in told.collect()] == [("a.txt", False), ("b.txt", True), ("c.docx", False)]
    assert tuple(jobs.inbox_tallies(told).first()) == (1, 2)
    assert sorted(p.name for p in (inbox / "processed").iterdir() if not p.name.startswith(".")) == ["b.json", "b.txt"]
    assert sorted(p.name for p in (inbox / "errors").iterdir() if not p.name.startswith(".")) == ["a.txt", "c.docx"]
    row = base.read("store").first()
    assert (row.title, row.category, row.filename, len(row.embedding)) == ("Title", "avviso", "b.txt", 8)
    assert jobs.take_inbox(base, str(inbox)).count() == 0


def test_command_line(spark, tmp_path, capsys):
    urls = tmp_path / "urls"
    urls.write_text("text:<title>T</title><main><p>" + "words of a page " * 20 + "</p></main>\ntext:<p>short</p>\n")
    root = ["--root", str(tmp_path / "base")]
    main([*root, "sync", "full", "--urls", str(urls), "--fetcher", "text"], spark)
    main([*root, "index"], spark)
    main([*root, "cleanup", "--dry-run"], spark)
    main([*root, "stats"], spark)
    out = capsys.readouterr().out
    assert "full|" in out and "html|" in out
    assert jobs.Base(spark, root[1]).read("store").count() == 1


def test_stream_state_of_whole_crawls(spark, tmp_path):
    kind = "url string, html string, title string, file string, seq int"
    source = tmp_path / "pages"
    add = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(kind).parquet(str(source))
        streams.run_crawl_state(stream, str(tmp_path / "state"), lambda d: d.count(), str(tmp_path / "cp"), lambda: "now", "seq", whole=True).awaitTermination()
        return {r.url: r.title for r in readers.read_snapshot(spark, str(tmp_path / "state"), schemas.STATE).collect()}

    add([("a", "z", "late", "f", 2), ("a", "y", "early", "f", 1), ("b", "1", "t", "f", 1)])
    assert run() == {"a": "late", "b": "t"}
    add([("b", "1", "t", "f", 3), ("c", "1", "t", "f", 3)])
    assert run() == {"b": "t", "c": "t"}


def test_embedding_service(spark):
    import http.server
    import threading

    from atlaskb.operators import embedding

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            bad = len(asked) > 1 and "bad" in asked
            body = json.dumps({"embeddings": [[float(len(t)), 1.0] for t in asked]}).encode()
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = embedding.service_embedder(f"http://127.0.0.1:{server.server_port}/", "m", chars=4)
        assert ask(["ab", "abcdef"]) == [[2.0, 1.0], [4.0, 1.0]]
        assert embedding.resilient(ask, 2)(["bad", "x"]) == [[3.0, 1.0], [1.0, 1.0]]
        server.shutdown()
        server.server_close()
        assert embedding.resilient(ask, 2)(["x"]) == [[0.0, 0.0]]
    finally:
        server.server_close()


def test_settings_from_a_file(tmp_path):
    (tmp_path / ".env").write_text("# comment\nSITE_URL='https://a'\nCRAWL_ALLOWED_DOMAINS=x.org, y.org\n")
    found = Settings.from_env({"SITE_URL": "https://b"}, str(tmp_path / ".env"))
    assert (found.site_url, found.allowed_domains) == ("https://b", ("x.org", "y.org"))


def test_answers_and_evaluation_of_a_base(spark, tmp_path):
    page = lambda words: (f"text:{words}", 200, "text/html", f"<title>{words}</title><main><p>{(words + ' ') * 12}</p></main>".encode(), None)
    fetched = spark.createDataFrame([page("opening hours of the office"), page("identity card renewal")], fetch.SCHEMA)
    base = jobs.Base(spark, str(tmp_path / "base"), Settings(embedding_dim=64, least_similarity=0.1))
    assert jobs.sync(base, "full", fetched).first().chunks == 2
    rules = jobs.Rules(
        spark.createDataFrame([(0, "document", ["identity card"])], "ord int, term string, synonyms array<string>"),
        spark.createDataFrame([(0, ["office"], "Desk", "/d")], "ord int, keywords array<string>, name string, url string"),
        spark.createDataFrame([], "ord int, keywords array<string>, require_any array<string>, text string, title string, source string, category string"),
        "it", "en",
    )
    cases = spark.createDataFrame([(1, "when is the office open", ["hours"], 1), (2, "renewal of my document", [], 1)], "query_id long, question string, expected_keywords array<string>, min_chunks int")
    history = spark.createDataFrame([(1, 0, "user", "hello")], "query_id long, turn int, role string, content string")
    got = {r.query_id: r for r in jobs.answer(base, cases, rules, history).collect()}
    assert got[1].sources[0].title == "opening hours of the office" and got[2].sources[0].title == "identity card renewal"
    assert [m.role for m in got[1].messages] == ["system", "user", "user"] and "[Fonte 1: opening hours" in got[1].messages[-1].content
    results, summary = jobs.evaluate(base, cases, rules)
    assert results.where("retrieval_ok").count() == summary.first().retrieval_ok == 2
