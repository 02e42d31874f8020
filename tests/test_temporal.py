"""Temporal functions over columns against the exact arithmetic that literals go through."""

import datetime as dt

import pytest
from pathloom.sources.graph import PropertyGraph

TEXTS = {
    "date": ["2021-03-04", "20210304", "2019-W08-3", "2019W083", "2020-W53", "2020W01", "2019-Q4-30", "2019Q230", "2023-200", "2024366", "1987-11", "198711", "1987"],
    "localtime": ["07:08:09.123456789", "070809", "0708", "07", "23:59:59,5"],
    "time": ["07:08:09+05:30", "0708-0330", "07Z", "07:08[Asia/Kolkata]", "07:08:09.25"],
    "localdatetime": ["2021-03-04T07:08:09.123456", "2019-W08-3T0708", "1987", "2023-200T07:08:09"],
    "datetime": ["2021-03-04T07:08:09+05:30", "2021-07-04T07:08:09[Europe/Paris]", "2021-01-04T07:08:09.123456789Z", "2021-03-04T07:08", "20210304"],
    "duration": ["P3Y5M", "P2W", "P1DT36H", "-P1M", "PT0.25S", "P1.5D", "P0.5M", "PT-90M"],
}
MAPS = {
    "date": ["{year: y, month: m, day: d}", "{year: y}", "{year: y, week: w, dayOfWeek: 3}", "{year: y, ordinalDay: d + 40}", "{year: y, quarter: 3, dayOfQuarter: d}", "{date: a, day: d}", "{date: a, week: w}", "{date: a, quarter: 2}"],
    "localtime": ["{hour: m, minute: d, second: w}", "{hour: m, nanosecond: y}", "{time: c, minute: d}"],
    "time": ["{hour: m, minute: d, timezone: '+02:00'}"],
    "localdatetime": ["{year: y, month: m, day: d, hour: m, millisecond: y}", "{date: a, time: c}", "{datetime: b, day: d}"],
    "datetime": ["{year: y, month: m, day: d, hour: m, timezone: 'America/New_York'}", "{date: a, hour: m, timezone: '-07:00'}"],
    "duration": ["{years: y, months: m, days: d}", "{days: -d, hours: 30, minutes: m}", "{weeks: 1.5, seconds: d, nanoseconds: -y}", "{months: 0.5, milliseconds: -1500}"],
}
UNITS = ["millennium", "century", "decade", "year", "weekYear", "quarter", "month", "week", "day"]
SHOWN = {"date": "{x}", "localtime": "{x}.hour, {x}.minute, {x}.second, {x}.nanosecond", "time": "{x}.hour, {x}.minute, {x}.nanosecond, {x}.offset", "localdatetime": "{x}", "datetime": "{x}.epochSeconds, {x}.nanosecond, {x}.offset, {x}.timezone", "duration": "{x}.months, {x}.days, {x}.seconds, {x}.nanosecondsOfSecond"}
NUMBERS = [(2004, 2, 29, 9), (1999, 12, 31, 52), (2021, 1, 1, 1)]


@pytest.fixture(scope="module")
def graph(spark):
    return PropertyGraph(spark)


@pytest.mark.parametrize("kind", TEXTS)
def test_texts(graph, kind):
    show = SHOWN[kind].format(x="v")
    got = graph.cypher(f"UNWIND range(0, {len(TEXTS[kind]) - 1}) AS i WITH i, $texts[i] AS t WITH i, {kind}(t) AS v RETURN i, {show} ORDER BY i", texts=TEXTS[kind]).collect()
    for row, text in zip(got, TEXTS[kind], strict=True):
        assert tuple(row)[1:] == tuple(graph.cypher(f"WITH {kind}('{text}') AS v RETURN {show}").first()), text


@pytest.mark.parametrize("kind", MAPS)
def test_maps(graph, kind):
    show = SHOWN[kind].format(x="v")
    for y, m, d, w in NUMBERS:
        for fields in MAPS[kind]:
            literal = fields
            for name, value in {"year: y": f"year: {y}", "years: y": f"years: {y}", "month: m": f"month: {m}", "months: m": f"months: {m}", "days: -d": f"days: -{d}", "days: d": f"days: {d}", "day: d": f"day: {d}", "week: w": f"week: {w}", "d + 40": str(d + 40), "dayOfQuarter: d": f"dayOfQuarter: {d}", "hour: m": f"hour: {m}", "minute: d": f"minute: {d}", "minutes: m": f"minutes: {m}", "second: w": f"second: {w}", "seconds: d": f"seconds: {d}", "nanosecond: y": f"nanosecond: {y}", "nanoseconds: -y": f"nanoseconds: -{y}", "millisecond: y": f"millisecond: {y % 1000}", "date: a": "date: date('2015-10-21')", "time: c": "time: localtime('10:11:12.000000013')", "datetime: b": "datetime: localdatetime('2016-02-29T13:14:15.161718')"}.items():
                literal = literal.replace(name, value)
            prefix = f"UNWIND [{y}] AS y UNWIND [{m}] AS m UNWIND [{d}] AS d UNWIND [{w}] AS w UNWIND [date('2015-10-21')] AS a UNWIND [localdatetime('2016-02-29T13:14:15.161718')] AS b UNWIND [localtime('10:11:12.000000013')] AS c"
            try:
                want = tuple(graph.cypher(f"WITH {kind}({literal}) AS v RETURN {show}").first())
            except Exception:  # not a date: the columns must not make one either
                with pytest.raises(Exception, match="INVALID|not a|range|year|Invalid"):
                    graph.cypher(f"{prefix} WITH {kind}({fields.replace('millisecond: y', 'millisecond: y % 1000')}) AS v RETURN {show}").first()
                continue
            got = tuple(graph.cypher(f"{prefix} WITH {kind}({fields.replace('millisecond: y', 'millisecond: y % 1000')}) AS v RETURN {show}").first())
            assert got == want, (fields, y, m, d, w)


@pytest.mark.parametrize(("kind", "source"), [("date", "date('1984-10-11')"), ("localdatetime", "localdatetime('1984-10-11T12:31:14.645876')"), ("datetime", "datetime('1984-10-11T12:31:14.645876123[Europe/Paris]')"), ("localtime", "localtime('12:31:14.645876123')"), ("time", "time('12:31:14.645876123-03:00')")])
def test_truncation(graph, kind, source):
    units = ([] if kind in ("localtime", "time") else UNITS[:-1]) + ([] if kind == "date" else ["day", "hour", "minute", "second", "millisecond", "microsecond"])
    fields = {"date": "{day: 2}", "localdatetime": "{day: 2, nanosecond: 3000}", "datetime": "{month: 3, timezone: '+04:00'}", "localtime": "{minute: 5, microsecond: 7}", "time": "{timezone: '+01:00', nanosecond: 9}"}[kind]
    for more in ("", f", {fields}"):
        items = ", ".join(f"{kind}.truncate('{u}', SOURCE{more}) AS u{i}" for i, u in enumerate(units))
        shown = ", ".join(SHOWN[kind].format(x=f"u{i}") + "" for i in range(len(units)))
        shown = ", ".join(f"{x} AS r{j}" for j, x in enumerate(shown.split(", ")))
        want = graph.cypher(f"WITH {items.replace('SOURCE', source)} RETURN {shown}").first()
        got = graph.cypher(f"UNWIND [{source}] AS s WITH {items.replace('SOURCE', 's')} RETURN {shown}").first()
        assert tuple(got) == tuple(want)


def test_epochs_beyond_32_bits(graph):
    got = graph.cypher("UNWIND [4102444800, -62135596800, 253402300799] AS s RETURN datetime.fromepoch(s, 1500000000).epochSeconds AS a, datetime.fromepoch(s, 7).nanosecond AS n, datetime.fromepochmillis(s * 1000 + 5).epochMillis AS m, datetime.fromepoch(s, 0).year AS y").collect()
    assert [tuple(r) for r in got] == [(s + 1, 7, s * 1000 + 5, y) for s, y in ((4102444800, 2100), (-62135596800, 1), (253402300799, 9999))]


def test_durations_between_columns_of_times_and_zones(graph):
    row = graph.cypher("UNWIND [datetime('2020-01-01T00:00+02:00')] AS a UNWIND [datetime('2020-01-01T00:00-01:00')] AS b UNWIND [time('10:00+01:00')] AS c UNWIND [time('10:00Z')] AS d RETURN duration.inSeconds(a, b).hours AS x, duration.between(c, d).seconds AS y, duration.inDays(c, d).days AS z").first()
    assert tuple(row) == (3, 3600, 0)


@pytest.mark.parametrize("call", ["date('2021-13-01')", "date('x')", "localtime('25:00')", "datetime('2021-01-01Tx')", "duration('PX')", "date('2021-400')", "date('2019-W53')"])
def test_bad_texts_fail_when_read(graph, call):
    name, text = call[:-2].split("('")
    with pytest.raises(Exception, match="not a|INVALID|Invalid"):
        graph.cypher(f"UNWIND ['{text}'] AS t RETURN {name}(t) AS v").collect()
    assert graph.cypher(f"UNWIND [null, null] AS t WITH t WHERE t IS NOT NULL RETURN {name}(toString(t)) AS v").count() == 0


def test_nulls(graph):
    row = graph.cypher("UNWIND [1] AS i WITH CASE WHEN i > 1 THEN '2020-01-01' END AS t, CASE WHEN i > 1 THEN 1 END AS n RETURN date(t) AS a, datetime(t) AS b, duration({days: n}) AS c, date({year: n}) AS d, localtime({hour: n}) AS e, date.truncate('month', date(t)) AS f").first()
    assert tuple(row) == (None,) * 6 and dt.date.max
