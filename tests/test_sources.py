import io
import json
import os
import zipfile
from datetime import date, datetime, timezone

import pytest

from tapeline import io as tio
from tapeline.checks import CheckError
from tapeline.cli.main import main
from tapeline.sources import archives, datasource, http, market, news


class Fake:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def __call__(self, url, params):
        self.calls.append((url, dict(params)))
        a = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(a, Exception):
            raise a
        return a


def client(fake, **k):
    slept = []
    return http.Retrying(fake, sleep=slept.append, jitter=lambda a, b: 1.0, **k), slept


def ok(data):
    return http.Response(200, json.dumps(data))


def test_queries():
    assert news.build_query("all_us_market", ["a b", "S&P", "x"], source_language=None) == '("a b" OR "S&P" OR x)'
    assert news.build_query("candidate_criticism", ["m"], ['q"t'], " English ") == '(m) (q\\"t) sourcelang:english'
    with pytest.raises(ValueError):
        news.build_query("all_us_market", source_language="en;x")
    with pytest.raises(ValueError):
        news.build_query("other")


def test_retries():
    c, slept = client(Fake(http.Response(429, headers={"Retry-After": "7"}), http.TransportError("x"), ok({})), pause_seconds=2)
    assert news.fetch_day(c, "e", "q", date(2024, 1, 2)) == {}
    assert slept == [7.0, 61.0, 2]
    with pytest.raises(http.FetchError, match="HTTP status 404: no response body"):
        client(Fake(http.Response(404)))[0].get("e", {})
    with pytest.raises(http.FetchError, match="after retries"):
        client(Fake(http.Response(503)), max_retries=1)[0].get("e", {})
    with pytest.raises(http.FetchError, match="valid JSON"):
        news.fetch_day(client(Fake(http.Response(200, "<")))[0], "e", "q", date(2024, 1, 2))
    with pytest.raises(http.FetchError, match="unexpected"):
        news.fetch_day(client(Fake(ok([])))[0], "e", "q", date(2024, 1, 2))
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert http.retry_after_seconds({"retry-after": "Mon, 01 Jan 2024 00:00:30 GMT"}, now) == 30
    assert http.retry_after_seconds({"Retry-After": "-5"}) == 0 and http.retry_after_seconds({"Retry-After": "soon"}) is None
    assert http.retry_after_seconds({"RETRY-AFTER": " 1.5 "}) == 1.5 and http.retry_after_seconds({}) is None and http.retry_after_seconds(None) is None
    assert list(client(Fake(ok({})), max_retries=9)[0].waits()) == [31.0, 61.0, 121.0, 241.0, 481.0, 961.0, 1800.0, 1800.0, 1800.0]
    assert list(client(Fake(ok({})), max_retries=0)[0].waits()) == []


def test_every_event_is_reported():
    seen = []
    c, slept = client(Fake(http.TransportError("down"), http.Response(503), ok({})), pause_seconds=0)
    c.get("e", {}, seen.append, {"day": 1})
    assert [e["phase"] for e in seen] == ["request", "retry", "request", "retry", "request", "success"] and all(e["day"] == 1 for e in seen)
    assert seen[1]["error"] == "down" and seen[3]["status_code"] == 503 and slept == [31.0, 61.0]
    with pytest.raises(http.FetchError, match="down"):
        client(Fake(http.TransportError("down")), max_retries=2)[0].get("e", {}, seen.append)
    assert seen[-1]["phase"] == "fatal_failure"
    strict, _ = client(Fake(http.Response(501, "no")), statuses=frozenset((500,)))
    with pytest.raises(http.FetchError, match="501: no"):
        strict.get("e", {})


def spec(tmp_path, **k):
    return news.RunSpec(str(tmp_path / "raw"), str(tmp_path / "interim"), "e", date(2024, 1, 1), date(2024, 1, 3), ("all_us_market",), **k)


DAY = {"articles": [{"title": "A", "url": "u", "domain": "d", "language": "English"}, {"title": "B", "language": "French"}]}


def test_long_run(spark, tmp_path):
    s = spec(tmp_path)
    with pytest.raises(http.FetchError) as e:
        news.collect(spark, s, client(Fake(ok(DAY), http.Response(400, "no")), pause_seconds=0)[0])
    assert e.value.completed_days == 1 and e.value.next_missing_day == date(2024, 1, 2) and "resume=True" in e.value.resume_guidance
    status = news.run_status(spark, s)
    assert [r.checkpoint_exists for r in status.orderBy("date").collect()] == [True, False, False]
    assert news.dry_run(status, 10.0).first().estimated_minimum_duration_seconds == 20
    fake = Fake(ok(DAY))
    got = news.collect(spark, s, client(fake, pause_seconds=0)[0])["all_us_market"]
    assert (got["rows"], got["skipped"], len(fake.calls)) == (3, 1, 2)
    again = news.collect(spark, s, client(Fake(http.Response(500)))[0])
    assert news.totals(again)["rows"] == 3
    with pytest.raises(CheckError, match="another query"):
        news.collect(spark, spec(tmp_path, market_terms=("z",)), client(Fake(ok(DAY)))[0])
    with pytest.raises(CheckError, match="language"):
        news.collect(spark, spec(tmp_path, source_language=None), client(Fake(ok(DAY)))[0])
    for bad in ({"max_records": 0}, {"query_types": ()}):
        with pytest.raises(ValueError):
            from dataclasses import replace

            replace(s, **bad).check()


def test_existing_checkpoint_needs_resume(spark, tmp_path):
    s = spec(tmp_path, resume=False)
    path = news.checkpoint_path(s.raw_dir, "all_us_market", date(2024, 1, 1))
    os.makedirs(os.path.dirname(path))
    open(path, "w").write("{}")
    with pytest.raises(tio.OutputError):
        news.collect(spark, s, client(Fake(ok(DAY)))[0])


def test_prices(spark, tmp_path):
    body = "Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02,1,1,1,2,2,5\n2024-01-03,1,1,1,null,2,5\n,1,1,1,1,1,1\n"
    s = market.PriceSpec("e", str(tmp_path), date(2024, 1, 1), date(2024, 1, 5), ("spy", "vix"))
    path, rows = market.collect_prices(spark, s, Fake(http.Response(200, body)), sleep=lambda x: None)
    assert rows.count() == 2 and os.path.basename(path) == "prices_spy_vix_20240101_20240105.csv"
    assert tio.read_text_csv(spark, path).columns == list(market.PRICE_COLUMNS)
    with pytest.raises(tio.OutputError):
        market.collect_prices(spark, s, Fake(http.Response(200, body)), sleep=lambda x: None)
    with pytest.raises(http.FetchError, match="no usable"):
        market.preflight(s, Fake(http.Response(200, "Date,Close\n")), sleep=lambda x: None)
    assert market.preflight(s, Fake(http.Response(200, body)), sleep=lambda x: None) == 1
    with pytest.raises(ValueError):
        market.PriceSpec("e", "r", max_retries=-1).check()


def test_archives(spark, tmp_path):
    lines = "1 h http://x/20240102000000.gkg.csv.zip\n2 h http://x/20240101000000.gkg.csv.zip\n3 h http://x/20240102.export.zip\n\n"
    frame = spark.createDataFrame([(x,) for x in lines.splitlines()], "value string")
    urls = ["http://x/20240101000000.gkg.csv.zip", "http://x/20240102000000.gkg.csv.zip"]
    assert [r.archive_url for r in archives.archive_table(frame, date(2024, 1, 1), date(2024, 1, 2)).collect()] == urls
    assert [r.archive_url for r in archives.archive_table(frame, date(2024, 1, 1), date(2024, 1, 2), most=1).collect()] == urls[:1]
    assert archives.archive_table(frame, date(2024, 1, 3), date(2024, 1, 4)).count() == 0
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.csv", b"1\tBUBBLE talk\n2\tcalm\xff\n")
    (tmp_path / "20240101000000.gkg.csv.zip").write_bytes(buffer.getvalue())
    files = archives.read_archives(spark, str(tmp_path))
    rows = archives.archive_lines(files)
    hit = archives.matching(rows, ["bubble"])
    assert rows.count() == 2 and [r.row_text for r in hit.collect()] == ["1\tBUBBLE talk"]
    assert [(str(r.archive_date), r.matched_rows) for r in archives.manifest(rows, hit).collect()] == [("2024-01-01", 1)]
    with pytest.raises(ValueError):
        archives.matching(rows, [])


def test_archive_collector(spark, tmp_path):
    def fetch(url):
        import io
        import zipfile

        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("a.csv", "1\tBUBBLE talk, \"quoted\"\n2\tcalm\n" if "0101" in url else "3\tcalm\n")
        return buffer.getvalue()

    master = http.Response(200, "1 h http://x/20240102000000.gkg.csv.zip\n2 h http://x/20240101000000.gkg.csv.zip\n")
    spec = archives.ArchiveSpec("m", str(tmp_path), date(2024, 1, 1), date(2024, 1, 2), ("bubble",), keep_archives=True)
    got = archives.collect_archives(spark, spec, client(Fake(master))[0], fetch)
    assert (got["archives"], got["rows"]) == (2, 1)
    assert [r.row_text for r in tio.read_text_csv(spark, got["extract"]).collect()] == ['1\tBUBBLE talk, "quoted"']
    assert [tuple(r) for r in tio.read_text_csv(spark, got["manifest"]).collect()] == [("http://x/20240101000000.gkg.csv.zip", "2024-01-01", "1"), ("http://x/20240102000000.gkg.csv.zip", "2024-01-02", "0")]
    fake = Fake(master)
    with pytest.raises(tio.OutputError):
        archives.collect_archives(spark, spec, client(fake)[0], fetch)
    assert not fake.calls
    with pytest.raises(ValueError):
        archives.collect_archives(spark, archives.ArchiveSpec("m", str(tmp_path), date(2024, 1, 1), date(2024, 1, 2), ()), client(fake)[0], fetch)


def test_one_shot_collection(spark, tmp_path):
    spec = news.RunSpec(str(tmp_path / "raw"), str(tmp_path / "interim"), "e", date(2024, 1, 1), date(2024, 1, 2), pause_seconds=0)
    fake = Fake(ok({"articles": [{"title": "A b", "url": "u", "domain": "d", "language": "English"}, {"title": "a  B!", "url": "v", "domain": "D"}]}))
    got = news.collect_once(spark, spec, client(fake, pause_seconds=0)[0], "all_us_market")
    assert got["rows"] == 2 and len(fake.calls) == 2  # one of each day's two is a copy
    with pytest.raises(tio.OutputError):
        news.collect_once(spark, spec, client(fake)[0], "all_us_market", overwrite=True)  # raw data is never replaced
    failing = news.RunSpec(str(tmp_path / "raw2"), str(tmp_path / "interim2"), "e", date(2024, 1, 1), date(2024, 1, 2))
    with pytest.raises(http.FetchError):
        news.collect_once(spark, failing, client(Fake(ok({"articles": []}), http.Response(404)), pause_seconds=0)[0], "all_us_market")
    assert not (tmp_path / "raw2").exists() and not (tmp_path / "interim2").exists()


def test_guards_on_any_file_system(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (tmp_path / "link").symlink_to(raw)
    for p in (f"file:{raw}/x", f"{tmp_path}/a/../raw/x", f"{tmp_path}/link/x"):
        with pytest.raises(tio.OutputError, match="raw"):
            tio.guard_output(p, True, f"file://{raw}")
    assert tio.guard_output(f"file:{tmp_path}/rawer", False, str(raw))
    tio.write_new_text(f"file:{tmp_path}/n/a.json", "é")
    with pytest.raises(Exception, match="exist"):
        tio.write_new_text(f"{tmp_path}/n/a.json", "")
    with pytest.raises(tio.OutputError):
        tio.guard_output(f"file:{tmp_path}/n/a.json")
    assert [f.rsplit("/", 1)[-1] for f in tio.list_files(f"{tmp_path}/n", ".json")] == ["a.json"] and tio.list_files(f"{tmp_path}/nowhere") == []


FETCHERS = """
def news(day, options):
    return [{"title": f"t {day}"}, "junk"]


def prices(symbol, options):
    return [("2024-01-01", symbol, *"123456")]
"""


def test_data_sources(spark, tmp_path):
    (tmp_path / "made_up_fetchers.py").write_text(FETCHERS)
    spark.sparkContext.addPyFile(str(tmp_path / "made_up_fetchers.py"))
    datasource.register(spark)
    df = spark.read.format("news_days").options(fetcher="made_up_fetchers:news", start="2024-01-01", end="2024-01-03").load()
    assert df.count() == 3 and df.rdd.getNumPartitions() == 3
    p = spark.read.format("symbol_prices").options(fetcher="made_up_fetchers:prices", symbols="spy,VIX").load()
    assert sorted(r.symbol for r in p.collect()) == ["SPY", "^VIX"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title\n1,"two\nlines, and ""quotes"""\n2,\n')
    (tmp_path / "b.csv").write_text("id,extra\n3,x\n")
    a = tio.read_text_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in a.collect()] == [("1", 'two\nlines, and "quotes"'), ("2", "")]
    both = tio.read_label_union(spark, str(tmp_path))
    assert sorted(map(tuple, both.select("id", "extra", "_annotation_file").collect())) == [("1", "", "a.csv"), ("2", "", "a.csv"), ("3", "x", "b.csv")]
    tio.write_csv(a.limit(0), str(tmp_path / "out"))
    assert any("id,title" in (tmp_path / "out" / f).read_text() for f in os.listdir(tmp_path / "out") if f.endswith(".csv"))
    with pytest.raises(tio.OutputError):
        tio.write_csv(a, str(tmp_path / "out"))
    with pytest.raises(tio.OutputError, match="raw"):
        tio.guard_output(str(tmp_path / "raw" / "x"), True, str(tmp_path / "raw"))
    os.makedirs(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        tio.label_files(str(tmp_path / "none"))


def test_command_lines(spark, tmp_path, capsys):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "m.csv").write_text("title,domain,url,source,query_type,date\nA,d,u,s,all_us_market,2024-01-01\nbubble B,d,v,s,all_us_market,2024-01-01\n")
    (tmp_path / "c.csv").write_text("title,domain,url,source,query_type,date\nA,d,u,s,candidate_criticism,2024-01-01\n")
    assert main(["build-index", "--market-csv", p("m.csv"), "--criticism-csv", p("c.csv"), "--output", p("index"), "--rolling-window", "2"]) == 0
    assert [r.narrative_index for r in tio.read_text_csv(spark, p("index")).collect()] == ["0.5"]
    assert main(["build-index", "--market-csv", p("m.csv"), "--criticism-csv", p("c.csv"), "--output", p("index")]) == 1
    assert "exists" in capsys.readouterr().err
    assert main(["annotation-sample", "--candidate-csv", p("c.csv"), "--all-market-csv", p("m.csv"), "--output-path", p("sample")]) == 0
    assert main(["validate-annotations", "--file", p("sample")]) == 0
    assert "Rows: 2" in capsys.readouterr().out
    (tmp_path / "h.csv").write_text("title,domain,seendate\nA,d,20240105213000\nA!,d,20240105213000\n")
    assert main(["clean-headlines", p("h.csv"), p("clean"), "--fuzzy"]) == 0
    assert tio.read_text_csv(spark, p("clean")).count() == 1
    assert main(["validate-annotations", "--labelled-dir", p("nowhere")]) == 1
