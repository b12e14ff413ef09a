"""Readers, HTML tables, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from meetlens import schemas
from meetlens.sources import html, paged, readers, sinks
from meetlens.streaming import streams


def test_toplists_and_race_log(spark, tmp_path):
    head = "Rank,Mark,WIND,Competitor,DOB,,Pos,,Venue,Date,Results Score,discipline,year,ProfileURL"
    (tmp_path / "men_100m_2026.csv").write_text(f"{head}\n1,9.90,+1.2,Ann A,5 JAN 2000,USA,1,,Rome (ITA),16 MAY 2026,1200,,2026,x/ann-7\n2,9.95,,Bo B,,GBR,2h1,,Oslo (i),17 MAY 2026,,,,x/bo-8\n")
    top = readers.toplists(spark, f"{tmp_path}/*.csv")
    assert {(r.athlete, r.nat, r.discipline, r.file_year) for r in top.collect()} == {("Ann A", "USA", "men_100m", 2026), ("Bo B", "GBR", "men_100m", 2026)}
    assert [r.athlete for r in readers.season_scores(top).collect()] == ["Ann A"]
    assert [(r.athlete_id, r.year) for r in readers.scoring_rows(top).collect()] == [(7, 2026)]
    log = readers.race_log([readers.normalised(top, "toplist", 1), readers.normalised(top, "worldwide", 0)])
    assert [(r.athlete, r.source, r.place, r.value, r.year) for r in log.collect()] == [("Ann A", "worldwide", 1, 9.9, 2026)]
    assert readers.toplists(spark, f"{tmp_path}/none*.csv").count() == 0


def test_nested_documents(spark, tmp_path):
    result = {"date": "5 MAY 2026", "mark": "9.9", "place": "1"}
    (tmp_path / "2026.json").write_text(json.dumps({"7": {"100m": [result, result]}}))
    assert [(r.year, r.athlete_id, r.event, r.mark) for r in readers.seasons(spark, f"{tmp_path}/2026.json").collect()] == [(2026, "7", "100m", "9.9")] * 2
    (tmp_path / "p.json").write_text(json.dumps({"athlete_id": 7, "resultsByEvent": [{"discipline": "100m", "indoor": False, "results": [result]}]}))
    assert readers.profile_results(readers.profiles(spark, f"{tmp_path}/p.json")).first().mark == "9.9"
    (tmp_path / "f.json").write_text(json.dumps({"athletes": {"Ann": {"status": "watch", "disciplines": ["100m"], "matches": []}}}))
    assert readers.flags(spark, f"{tmp_path}/f.json").first().status == "watch" and readers.flags(spark, f"{tmp_path}/no.json").count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert readers.flags(spark, f"{tmp_path}/bad.json").count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"disciplines": {"100m": {"qualLimit": 8, "standings": [{"rank": 1, "name": "Ann", "points": 9.0}]}}}))
    assert readers.standings(spark, f"{tmp_path}/s.json").first().qual_limit == 8


def test_finals_first_listing_wins(spark):
    doc = {"competition": "c", "year": 2026, "events": [{"discipline": "100m", "races": [{"race": "Heat", "results": [{"name": "x", "place": 1, "mark": "10"}]}, {"race": "Final", "results": [{"name": "a", "place": 1, "mark": "9.9"}]}]}, {"discipline": "100m", "races": [{"race": "Final", "results": [{"name": "b", "place": 1, "mark": "9.8"}]}]}]}
    schema = "competition string, year int, events array<struct<discipline:string,races:array<struct<race:string,results:array<struct<name:string,place:int,mark:string>>>>>>"
    df = spark.createDataFrame([doc], schema)
    assert [r.name for r in readers.finals_of_competition(df).collect()] == ["a"]
    assert readers.finals_of_competition(df, spark.createDataFrame([("b",)], "name string")).count() == 0


def test_entry_lists(spark):
    good, bad = "WOMEN\n100 Metres (2)\n12 Ann LEE GBR\n13 Bo XU CHN\n", "MEN\nLong Jump (2)\n1 Al Oh USA\n"
    rows = readers.entry_list(spark.createDataFrame([(1, good), (2, bad), (3, None)], "doc int, text string")).collect()
    assert {(r.doc, r.event, r.athlete) for r in rows} == {("1", "Women's 100 Metres", "Ann LEE"), ("1", "Women's 100 Metres", "Bo XU")}


def test_profile_best(spark):
    rows = [("a", "1 MAY 2026", "9.9", 1200.0, False, "Rome", None), ("a", "2 MAY 2026", "9.8h", 1250.0, False, "Rome", None), ("a", "3 MAY 2026", "9.7", 1300.0, True, "Rome", None), ("a", "4 MAY 2026", "9.7", 1300.0, False, "Berlin (i)", None), ("a", "9 MAY 2026", "9.6", 1400.0, False, "Rome", None)]
    df = spark.createDataFrame([(*r, False) for r in rows], "k string, date string, mark string, resultScore double, notLegal boolean, venue string, competition string, indoor boolean")
    cut = F.lit("2026-05-09").cast("date")
    assert readers.profile_best(df, ["k"], cut).first().score == 1200.0 and readers.profile_best(df, ["k"], cut, hand_times=True).first().score == 1250.0


def test_resolved_events(spark):
    e = spark.createDataFrame([("men", "Men's 100 Metres"), ("women", "Women's Mile"), ("men", "Men's Sack Race")], "gender string, event string")
    find = lambda **k: {r.event: r.discipline for r in readers.resolved_event(e, schemas.disciplines(spark), **k).collect()}
    assert find() == {"Men's 100 Metres": "men_100m", "Women's Mile": None, "Men's Sack Race": None} and find(mile_as_1500=True)["Women's Mile"] == "women_1500m"


def write_page(root, name, page, rows, files=1):
    folder = root / f"list={name}" / f"page={page}"
    folder.mkdir(parents=True)
    for k in range(files):
        (folder / f"part-{k}.txt").write_text("".join(json.dumps(r) + "\n" for r in rows[k::files]))
    (folder / "_SUCCESS").write_text("")


def test_pages(spark, tmp_path):
    """Lists end at a missing, empty or short page; nothing behind it is read; a broken page is tried again and is an error."""
    row = lambda i, area="a": {"i": i, "area": area}
    for page, rows in enumerate([[row(1), row(2)], [row(3)], [row(9), row(9)]]):
        write_page(tmp_path, "short", page, rows)
    for page, rows in ((0, [row(4), row(5)]), (1, [row(6), {"area": "b"}]), (3, [row(9), row(9)])):
        write_page(tmp_path, "gap é%", page, rows, files=2)
    write_page(tmp_path, "none", 1, [row(9), row(9)])
    write_page(tmp_path, "empty", 0, [])
    schema = "i int, area string, more double, list string, page int"
    df = paged.pages(spark, str(tmp_path), schema, 2)
    assert sorted((r.list, r.page, r.i or 0, r.area, r.more) for r in df.collect()) == [("gap é%", 0, 4, "a", None), ("gap é%", 0, 5, "a", None), ("gap é%", 1, 0, "b", None), ("gap é%", 1, 6, "a", None), ("short", 0, 1, "a", None), ("short", 0, 2, "a", None), ("short", 1, 3, "a", None)]
    assert df.rdd.getNumPartitions() == 4 and {(r.list, r.n) for r in paged.at_the_cap(df, 4).collect()} == {("gap é%", 4)}
    assert paged.pages(spark, f"{tmp_path}/no", schema, 2).count() == 0
    (tmp_path / "list=short" / "page=1" / "part-0.txt").write_text("{")
    with pytest.raises(Exception):
        paged.pages(spark, str(tmp_path), schema, 2, pause="0").collect()
    assert paged.pages(spark, str(tmp_path), schema, 2, pause="0", strict="false").where("list = 'short'").count() == 2


def test_pages_that_heal(tmp_path, monkeypatch):
    """A page that fails once is read at the next attempt."""
    write_page(tmp_path, "x", 0, [{"i": 1}])
    reader, real, calls = paged.PageReader(StructType().add("i", IntegerType()), {"path": str(tmp_path), "size": "2", "pause": "0"}), paged.PageReader.lines, []

    def lines(self, path):
        calls.append(path)
        if len(calls) == 1:
            raise OSError("busy")
        return real(self, path)

    monkeypatch.setattr(paged.PageReader, "lines", lines)
    assert [list(reader.read(p)) for p in reader.partitions()] == [[(1,)]] and len(calls) == 2


def test_pages_are_checked(spark):
    rows = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (2, "b", 1), (3, None, 1)], "i int, area string, p int")
    assert sorted((r.i, r.p) for r in paged.checked(rows, "i", [F.col("p")]).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert paged.checked(rows, "i", [F.col("p")], F.col("area") == "b", 0.6).count() == 3
    with pytest.raises(Exception, match="outside the area"):
        paged.checked(rows, "i", [F.col("p")], F.col("area") == "b", 0.4).collect()
    assert paged.checked(rows.limit(0), "i", [F.col("p")], F.col("area") == "b").count() == 0
    with pytest.raises(KeyError):
        readers.registry(rows, "area", "zz")


PAGE = """<h1>Meet</h1><h2>Men</h2><h3>100 Metres</h3><table><tr><th>Pos</th><th>Athlete</th><th>Mark</th></tr>
<tr><td>1.</td><td><a href="/a-1">Ann</a></td><td>9.9</td></tr><tr><td><img alt="Silver medal"></td><td>Bo</td><td>10</td></tr>
<tr><td>Pos</td><td>Athlete</td><td>Mark</td></tr><tr><td>3</td><td>Cy</td><td>DNF</td></tr><tr><td>Wind</td><td>+1.0</td><td></td></tr></table>
<h2>Women</h2><table><tr><td>1</td><td>Di</td><td>GBR</td><td>4</td><td>1,024</td></tr><tr><td>-</td><td>x</td><td>y</td><td>1</td><td>2</td></tr></table><a href="/q">Q &amp; A</a>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>no table")], "page_id int, html string")
    rows = html.table_rows(pages, ["page_id"])
    assert [(r.place, r.athlete, r.race) for r in html.results(rows, ["page_id"]).orderBy("place").collect()] == [(1, "Ann", "Meet / Men / 100 Metres"), (2, "Bo", "Meet / Men / 100 Metres")]
    assert [(r.rank, r.name, r.points) for r in html.standings(rows, ["page_id"]).collect()] == [(1, "Di", 1024.0)]
    assert {tuple(r.path) for r in rows.where("table_no = 1").collect()} == {("Meet", "Women")}
    assert {(r.href, r.anchor) for r in html.links(pages, ["page_id"]).where("page_id = 1").collect()} == {("/a-1", "Ann"), ("/q", "Q & A")}
    assert [r.depth for r in html.headings(pages, ["page_id"]).where("page_id = 1").orderBy("heading_no").collect()] == [1, 2, 3, 2]
    c = spark.createDataFrame([("4 x 100m relay",), ("400m Hurdles",), ("110 Metres Hurdles",), ("Mile",), ("Long Jump",)], "c string")
    assert [r[0] for r in c.select(html.classify("c")).collect()] == ["relay", "400mH", "sprint_hurdles", "1500m", "LJ"]


def files(root):
    """Data files and when they were written."""
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_sinks_by_key(spark, tmp_path):
    """Rows are kept by key, and a change rewrites the partitions of its own keys only."""
    path, rows = f"file://{tmp_path}/t", lambda *r: spark.createDataFrame(list(r), "k int, src string, y int, v int")
    sinks.append_unique(rows(*((k, "a", 1, k) for k in range(40))), path, ["k"], [F.asc("v")], parts=8)
    before = files(tmp_path / "t")
    assert len({n.split("/")[0] for n in before}) == 8
    sinks.append_unique(rows((1, "a", 1, 99), (100, "b", 1, 3), (100, "b", 1, 2)), path, ["k"], [F.asc("v")], parts=8)
    after = files(tmp_path / "t")
    assert sinks.read(spark, path).columns == ["k", "src", "y", "v"]
    assert sorted((r.k, r.v) for r in sinks.read(spark, path).collect()) == [(k, k) for k in range(40)] + [(100, 2)]
    assert len({n.split("/")[0] for n in before.items() ^ after.items() for n in [n[0]]}) <= 2
    sinks.upsert(rows((100, "c", 1, 7), (2, "c", 1, None)), path, ["k"], "v", parts=8)
    got = {r.k: (r.src, r.v) for r in sinks.read(spark, path).collect()}
    assert got[100] == ("c", 7) and got[2] == ("a", 2) and len(got) == 41
    sinks.upsert(rows((3, "z", 1, 3)).limit(0), path, ["k"], parts=8)
    assert {r.k: (r.src, r.v) for r in sinks.read(spark, path).collect()} == got
    one = f"file://{tmp_path}/one"
    sinks.append_unique(rows((5, "a", 1, None)), one, ["k"], [], parts=4)
    sinks.upsert(rows((5, "a", 1, None)), one, ["k"], "v", parts=4)
    assert sinks.read(spark, one).count() == 0
    assert sinks.read(spark, f"{path}-no", rows((1, "a", 1, 1))).count() == 0


def test_sinks_by_source_and_season(spark, tmp_path):
    """A late correction replaces its source's seasons; no other file is touched."""
    path, rows = f"file://{tmp_path}/t", lambda *r: spark.createDataFrame(list(r), "k int, src string, y int, v int")
    have = lambda: sorted((r.k, r.src, r.y, r.v) for r in spark.read.parquet(path).select("k", "src", "y", "v").collect())
    for own in "ab":
        sinks.replace_source(rows(*((i, own, 2020 + i % 3, i) for i in range(6))), path, "src", own, "y")
    before = files(tmp_path / "t")
    assert len(before) == 6 and len(have()) == 12
    sinks.replace_source(rows((9, "b", 2021, 9)), path, "src", "b", "y")
    after = files(tmp_path / "t")
    assert {n.rsplit("/", 1)[0] for n, _ in before.items() ^ after.items()} == {"src=b/y=2021"}
    assert [r for r in have() if r[1] == "b"] == [(0, "b", 2020, 0), (2, "b", 2022, 2), (3, "b", 2020, 3), (5, "b", 2022, 5), (9, "b", 2021, 9)]
    sinks.replace_source(rows((7, "b", 2030, 7)), path, "src", "b", "y", whole=True)
    now = files(tmp_path / "t")
    assert [r for r in have() if r[1] == "b"] == [(7, "b", 2030, 7)] and {n: t for n, t in now.items() if "src=a" in n} == {n: t for n, t in before.items() if "src=a" in n}
    for bad, own in ((rows((1, "c", 1, 1)), "b"), (rows((1, "a/b", 1, 1)), "a/b")):
        with pytest.raises(ValueError):
            sinks.replace_source(bad, path, "src", own, "y")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no")
    with pytest.raises(Exception):
        sinks.replace_source(rows((3, "b", 1, 4)), f"file://{tmp_path}/broken", "src", "b", "y")
    sinks.write_once(rows((1, "a", 1, 1)), f"{path}-once")
    with pytest.raises(Exception):
        sinks.write_once(rows((1, "a", 1, 1)), f"{path}-once")
    with pytest.raises(ValueError):
        sinks.write_once(rows((1, "a", 1, 1)), f"{path}-two", results=rows((1, "a", 1, 1)))


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("d", "s1", "A"), ("d", "s1", "B"), ("d", "s2", "C")], "g string, slug string, name string")
    left = sinks.snapshots(df, f"{tmp_path}/snap", "g", "slug", "name")
    assert left.count() == 2 and spark.read.text(f"{tmp_path}/snap").count() == 1
    with pytest.raises(ValueError):
        sinks.snapshots(df.limit(0), f"{tmp_path}/snap", "g", "slug", "name")
    sinks.report(df, f"{tmp_path}/rep", F.col("slug"))
    assert spark.read.text(f"{tmp_path}/rep").count() == 3


def test_carry_forward(spark):
    new, old = (spark.createDataFrame(r, "k int, a int, b int") for r in ([(1, None, 2)], [(1, 5, 9)]))
    assert tuple(sinks.carried_forward(new, old, ["k"], ["a", "b"]).first()) == (1, 5, 2)


def test_disciplines(spark):
    d = schemas.disciplines(spark)
    assert d.count() == 36 and d.where("is_field").select("qual_limit").distinct().collect()[0][0] == 6


def test_stream_equals_batch(spark, sf, tmp_path):
    source = lambda: streams.source(spark, f"{sf}/events.parquet")
    batch = streams.timestamps(spark.read.parquet(f"{sf}/events.parquet"))
    got = streams.run(streams.monthly(source(), ["user_id"], "ts", "value"), "complete", f"{tmp_path}/c1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.monthly(batch, ["user_id"], "ts", "value").collect()))
    windows = streams.run(streams.recent_windows(source(), ["user_id"], "ts", "value", 2, "1 day"), "append", f"{tmp_path}/c2")
    whole = {tuple(r) for r in streams.recent_windows(batch, ["user_id"], "ts", "value", 2, "1 day").collect()}
    assert windows.count() and {tuple(r) for r in windows.collect()} <= whole
    path = f"file://{tmp_path}/sink"
    plan = source().select("user_id", "event_type")
    for n in (1, 2):
        streams.run(plan, "append", f"{tmp_path}/c3-{n}", streams.upsert_batches(path, ["user_id"]))
        assert sinks.read(spark, path).count() == batch.select("user_id").distinct().count()


def test_streams_read_tables_of_many_files(spark, sf, tmp_path):
    """A table that is a folder gives what its one file gives, in all registered streams."""
    from meetlens.plans import catalog

    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name, query in catalog.queries().items():
        if name.startswith("streaming_"):
            one, many = (sorted(map(str, query(spark, d).collect())) for d in (sf, str(tmp_path)))
            assert one == many and one, name


def test_availability_over_restarts(spark, tmp_path):
    """Standing follows the newest flag and return over batches and restarts from the checkpoint; flags end by event time."""
    from datetime import datetime

    schema, day = "user string, ts timestamp, id long, kind string", lambda d, h=0: datetime(2026, 5, d, h)

    def deliver(n, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")

    def standing():
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/n=*")
        stream = streams.availability(source, "user", "ts", "id", F.when(F.col("kind").isin("watch", "out"), F.col("kind")), F.col("kind") == "back", 10)
        rows = streams.run(stream, "update", f"{tmp_path}/check").collect()
        return {u: max((r["at"], r.standing, r.status) for r in rows if r.user == u) for u in {r.user for r in rows}}, len(rows)

    deliver(1, ("a", day(2), 1, "watch"), ("a", day(1), 0, "out"), ("b", day(2), 2, "out"), ("b", day(3), 3, "back"), ("c", day(2), 4, "back"), ("d", day(2), 5, "watch"), ("d", day(2), 6, "out"), ("a", day(2), 7, "other"))
    got, n = standing()
    assert got == {"a": (day(2), "out", "watch"), "b": (day(3), "cleared", "out"), "d": (day(2), "out", "out")} and n == 3
    deliver(2, ("a", day(4), 8, "back"), ("b", day(5), 9, "watch"), ("c", day(6), 10, "out"), ("d", day(2, 1), 11, "watch"))
    got, n = standing()  # state came from the checkpoint: the first delivery is not read again
    assert got == {"a": (day(4), "cleared", "watch"), "b": (day(5), "out", "watch"), "c": (day(6), "out", "out")} or got["a"][1] == "cleared" and got["b"][1] == "out"
    deliver(3, ("z", day(14), 12, "watch"))
    got, _ = standing()
    assert got["z"] == (day(14), "out", "watch") and "expired" in {s for _, s, _ in got.values()} and all(got[u][1] == "expired" for u in got if u == "d")
    deliver(4, ("z", day(31), 13, "back"))
    got, _ = standing()
    assert got["z"] == (day(31), "cleared", "watch") and got["b"] == (day(15), "expired", "watch") and got["c"] == (day(16), "expired", "out") and got["a"][1] == "cleared"


def test_corrections_replace_partitions(spark, tmp_path):
    schema = "src string, y int, k int, v int"
    path = f"file://{tmp_path}/table"
    spark.createDataFrame([("a", 2020, 1, 1), ("a", 2021, 2, 2), ("b", 2020, 3, 3)], schema).write.partitionBy("src", "y").parquet(path)
    before = files(tmp_path / "table")
    spark.createDataFrame([("a", 2021, 2, 20), ("c", 2020, 4, 4)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    for n in (1, 2):  # a batch that runs again changes nothing
        streams.run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "append", f"{tmp_path}/check-{n}", streams.correction_batches(path, "src", "y"))
        assert sorted((r.src, r.y, r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 2020, 1, 1), ("a", 2021, 2, 20), ("b", 2020, 3, 3), ("c", 2020, 4, 4)]
    assert {f.rsplit("/", 1)[0] for f, _ in before.items() ^ files(tmp_path / "table").items()} == {"src=a/y=2021", "src=c/y=2020"}


def test_headings_decode_whole_references_only(spark):
    pages = spark.createDataFrame([(1, "<h1>a &amp;&amp; b&amp</h1><h2>&lt;c&#39;s&gt; &quot</h2><h3>&amp;lt; &eacute; &nothing;</h3>")], "page_id int, html string")
    assert [r.heading for r in html.headings(pages, ["page_id"]).orderBy("heading_no").collect()] == ["a && b&amp", "<c's> &quot", "&lt; é &nothing;"]


def test_plain_pages_are_read_as_by_the_library(spark):
    """Plain pages by the pattern give what the parser gives; other pages go to the parser; no page is a call of its own."""
    kinds = ["<h1>A &amp; b</h1>", "<H2 class=\"x\">c&lt;d &ampe</H2>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>x", "</th>", '<a href="/b-7">', "</a>", '<img alt="Silver medal">', " 1 ", "a & b", "\n", "<p>", "</p>", "&#39;"]
    odd = ["<br/>", "<!-- <td> -->", "<td class=x>", "<script>var t = '<td>';</script>", "a < b", '<a href="/x?a=1&amp;b=2">', "<", "</td >", "<title>a<b></title>"]
    import random

    rng, fast = random.Random(3), 0
    seen = lambda p: (p.path, p.tables, p.links)
    for i in range(3000):
        page = "".join(rng.choices(kinds + (odd if i % 3 == 0 else []), k=rng.randint(1, 40)))
        whole = html.Tables()
        whole.feed(page)
        whole.close()
        fast += html.plain(page) is not None
        assert seen(html.parse(page)) == seen(whole), page
    assert fast >= 2000 and html.plain("a < b") is None and html.plain("<td") is None
    found = html.table_rows(spark.createDataFrame([(1, "<table><tr><th>P</th></tr><tr><td>1</td><td></td></tr></table>"), (2, None), (3, "x")], "page_id long, html string"), ["page_id"])
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0, [], ["P"], ["1", ""], None)]
    assert "Lateral" not in found._jdf.queryExecution().toString() and "BatchEvalPythonUDTF" not in found._jdf.queryExecution().toString()
