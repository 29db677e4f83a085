"""SQL that the queries of `demo` must agree with, over the same tables.

Built from common table expressions; ratios are rounded half up on whole numbers, which equals exact decimal rounding.
"""

from __future__ import annotations

from ..functions.calendar import DAYS, HOLIDAY_YEARS, MONTHS

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
CTES = {
    "r": """SELECT event_id, user_id AS station_id, ts AS releve_at, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, event_type FROM events""",
    "st": """SELECT c_custkey AS station_id, CAST(c_custkey AS VARCHAR) AS station_code, c_name AS nom_station, 48.0::DOUBLE + (c_custkey % 1000)::DOUBLE / 1000.0::DOUBLE AS latitude, 2.0::DOUBLE + (c_custkey * 7 % 1000)::DOUBLE / 1000.0::DOUBLE AS longitude,
        CAST(99 AS INTEGER) AS capacite, n_name AS commune0, CASE WHEN c_nationkey % 2 = 0 THEN '751' || lpad(CAST(c_custkey % 20 + 1 AS VARCHAR), 2, '0') WHEN c_nationkey > 1 THEN CAST(92000 + c_nationkey AS VARCHAR) END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "s": """SELECT station_id, station_code, nom_station, latitude, longitude, capacite, CASE WHEN code LIKE '751%' THEN 'Paris' ELSE commune0 END AS commune, CASE WHEN code LIKE '751%' THEN CAST(substr(code, 4, 2) AS INTEGER) END AS arrondissement,
        CASE WHEN code = '75101' THEN 'Paris 1er' WHEN code LIKE '751%' THEN 'Paris ' || CAST(CAST(substr(code, 4, 2) AS INTEGER) AS VARCHAR) || 'e' ELSE commune0 END AS zone, left(code, 2) AS departement, coalesce(code LIKE '751%', false) AS est_paris,
        DATE '2024-01-01' AS premiere_apparition, DATE '2024-01-31' AS derniere_apparition FROM st""",
    "f": """SELECT station_id, releve_at, CAST(strftime(releve_at + INTERVAL 1 HOUR, '%Y%m%d') AS INTEGER) AS date_id, CAST(extract(hour FROM releve_at + INTERVAL 1 HOUR) AS INTEGER) AS heure, k AS velos_disponibles, CAST(k % 10 AS INTEGER) AS velos_mecaniques, CAST(k - k % 10 AS INTEGER) AS velos_electriques, CAST(99 - k AS INTEGER) AS bornes_libres,
        CAST(99 AS INTEGER) AS capacite_effective, (k * 20000 + 99) // 198 AS rate, k = 0 AS est_vide, k = 99 AS est_pleine, event_type <> 'error' AS est_installee, event_type <> 'signup' AS location_active, true AS retour_actif FROM r WHERE station_id IN (SELECT station_id FROM s)""",
    "i": f"""SELECT station_id, releve_at, date_id, heure, est_vide, est_pleine, least(epoch_us(coalesce(lead(releve_at) OVER (PARTITION BY station_id ORDER BY releve_at), {AS_OF})) - epoch_us(releve_at), 7200000000) AS duree_us FROM f""",
    "hh": """SELECT unnest(generate_series((SELECT date_trunc('hour', min(releve_at)) FROM f), (SELECT date_trunc('hour', max(releve_at)) FROM f), INTERVAL 1 HOUR)) AS heure_debut""",
    "g": """SELECT station_id, heure_debut, heure_debut + INTERVAL 1 HOUR AS heure_fin FROM (SELECT DISTINCT station_id FROM s) CROSS JOIN hh""",
    "h": """SELECT g.station_id, g.heure_debut, g.heure_fin, CAST(strftime(g.heure_debut + INTERVAL 1 HOUR, '%Y%m%d') AS INTEGER) AS date_id, CAST(extract(hour FROM g.heure_debut + INTERVAL 1 HOUR) AS INTEGER) AS heure_locale, f.velos_disponibles, f.velos_mecaniques, f.velos_electriques, f.bornes_libres, f.capacite_effective, f.rate, f.releve_at AS dernier_releve_at,
        ((epoch_us(g.heure_fin) - epoch_us(f.releve_at)) * 20 + 60000000) // 120000000 AS tenths FROM g ASOF JOIN f ON g.station_id = f.station_id AND f.releve_at < g.heure_fin""",
}
HOURS = "station_id, heure_debut, heure_fin, date_id, heure_locale, velos_disponibles, velos_mecaniques, velos_electriques, bornes_libres, capacite_effective, rate / 10000.0::DOUBLE AS taux_remplissage, dernier_releve_at, tenths / 10.0::DOUBLE AS minutes_depuis_releve"
_NEEDS = {"st": (), "s": ("st",), "r": (), "f": ("r", "s"), "i": ("f",), "hh": ("f",), "g": ("s", "hh"), "h": ("g", "f")}


def _with(names: tuple[str, ...], query: str, **own: str) -> str:
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    made_once = lambda n: " AS MATERIALIZED" if n in ("h", "hx") else " AS"
    ctes = [f"{n}{made_once(n)} ({CTES[n]})" for n in wanted] + [f"{n}{made_once(n)} ({q})" for n, q in own.items()]
    return f"WITH {', '.join(ctes)} {query}"


def _half_up(top: str, bottom: str, scale: int) -> str:
    """top / bottom rounded to 1/scale, as a double."""
    return f"CAST(CASE WHEN ({bottom}) <> 0 THEN (2 * CAST({top} AS HUGEINT) * {scale} + ({bottom})) // (2 * CAST({bottom} AS HUGEINT)) END AS DOUBLE) / {scale}.0::DOUBLE"


def _days() -> str:
    from datetime import timedelta

    from ..functions.calendar import EASTER_HOLIDAYS, FIXED_HOLIDAYS, easter

    rows = [(f"{y}-{m:02d}-{d:02d}", n) for y in HOLIDAY_YEARS for (m, d), n in FIXED_HOLIDAYS.items()] + [(str(easter(y) + timedelta(k)), n) for y in HOLIDAY_YEARS for k, n in EASTER_HOLIDAYS.items()]
    values = ", ".join(f"(DATE '{d}', '{n.replace(chr(39), chr(39) * 2)}')" for d, n in rows)
    names = lambda x: "[" + ", ".join(f"'{n}'" for n in x) + "]"
    return f"""SELECT CAST(strftime(j, '%Y%m%d') AS INTEGER) AS date_id, j AS date_jour, CAST(isodow(j) AS INTEGER) AS jour_semaine_num, list_extract({names(DAYS)}, isodow(j)) AS jour_semaine, isodow(j) IN (6, 7) AS est_weekend, n IS NOT NULL AS est_ferie, n AS nom_ferie,
        CASE WHEN isodow(j) IN (6, 7) OR n IS NOT NULL THEN 'week-end / férié' ELSE 'semaine' END AS type_jour, CAST(day(j) AS INTEGER) AS jour, CAST(month(j) AS INTEGER) AS mois, list_extract({names(MONTHS)}, month(j)) AS nom_mois, CAST(year(j) AS INTEGER) AS annee, CAST(week(j) AS INTEGER) AS semaine_iso
        FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2026-01-05', INTERVAL 1 DAY)) AS DATE) AS j) LEFT JOIN (VALUES {values}) AS v(d, n) ON d = j"""


_CRITICAL = f"""SELECT c.station_id, {_half_up('seen', '3600000000', 10)} AS heures_observees, {_half_up('empty', '3600000000', 10)} AS heures_vide, {_half_up('fully', '3600000000', 10)} AS heures_pleine, vide / 10000.0::DOUBLE AS part_temps_vide, pleine / 10000.0::DOUBLE AS part_temps_pleine,
    {_half_up('empty7', 'seen7', 10000)} AS part_temps_vide_7j, {_half_up('full7', 'seen7', 10000)} AS part_temps_pleine_7j, nom_station, zone, commune, capacite,
    CAST(rank() OVER (ORDER BY vide DESC NULLS LAST) AS INTEGER) AS rang_vide, CAST(rank() OVER (ORDER BY pleine DESC NULLS LAST) AS INTEGER) AS rang_pleine FROM c JOIN s ON s.station_id = c.station_id"""


def _critical(columns: str = "*") -> str:
    sums = f"""SELECT station_id, sum(duree_us) AS seen, coalesce(sum(duree_us) FILTER (WHERE est_vide), 0) AS empty, coalesce(sum(duree_us) FILTER (WHERE est_pleine), 0) AS fully, sum(duree_us) FILTER (WHERE w) AS seen7,
        coalesce(sum(duree_us) FILTER (WHERE w AND est_vide), 0) AS empty7, coalesce(sum(duree_us) FILTER (WHERE w AND est_pleine), 0) AS full7 FROM (SELECT *, releve_at >= {AS_OF} - INTERVAL 7 DAY AS w FROM i) GROUP BY station_id"""
    shares = "SELECT *, CAST((20000 * empty + seen) // (2 * seen) AS BIGINT) AS vide, CAST((20000 * fully + seen) // (2 * seen) AS BIGINT) AS pleine FROM c0"
    return _with(("s", "i"), f"SELECT {columns} FROM ({_CRITICAL})", c0=sums, c=shares)


_MESSAGE = """SELECT event_id, k, station_id, releve_at, event_type, CASE WHEN k < 5 THEN substr(raw, 1, 20) ELSE raw END AS raw_json FROM (SELECT *, '{"station": {"station_id": ' || CASE WHEN k = 5 THEN 'null' ELSE CAST(station_id AS VARCHAR) END || ', "stationCode": "' || CAST(station_id AS VARCHAR) || '", "num_bikes_available": ' || CASE WHEN k = 9 THEN '-1' ELSE CAST(k AS VARCHAR) END
    || ', "num_bikes_available_types": [{"mechanical": ' || CAST(k % 10 AS VARCHAR) || '}, {"ebike": ' || CAST(k - k % 10 AS VARCHAR) || '}], "num_docks_available": ' || CASE WHEN k = 10 THEN '-1' ELSE CAST(99 - k AS VARCHAR) END || ', "is_installed": 1, "is_renting": ' || CASE WHEN event_type = 'signup' THEN '0' ELSE '1' END || ', "is_returning": 1, "last_reported": '
    || CASE WHEN k = 6 THEN 'null' WHEN k = 7 THEN '0' WHEN k = 8 THEN '4102444800' ELSE CAST(epoch_us(releve_at) // 1000000 AS VARCHAR) END || '}}' AS raw FROM r)"""
_EPOCH = "CASE WHEN k < 5 OR k = 6 THEN NULL WHEN k = 7 THEN 0 WHEN k = 8 THEN 4102444800 ELSE epoch_us(releve_at) // 1000000 END"
_PARSED = f"""SELECT CASE WHEN k > 5 THEN station_id END AS station_id, CASE WHEN k >= 5 THEN CAST(station_id AS VARCHAR) END AS station_code, CAST({_EPOCH} AS BIGINT) AS last_reported_epoch, TIMESTAMP '1970-01-01' + to_seconds({_EPOCH}) AS last_reported, CAST(CASE WHEN k < 5 THEN NULL WHEN k = 9 THEN -1 ELSE k END AS INTEGER) AS num_bikes_available,
    CAST(CASE WHEN k < 5 THEN 0 ELSE k % 10 END AS INTEGER) AS num_mechanical, CAST(CASE WHEN k < 5 THEN 0 ELSE k - k % 10 END AS INTEGER) AS num_ebike, CAST(CASE WHEN k < 5 THEN NULL WHEN k = 10 THEN -1 ELSE 99 - k END AS INTEGER) AS num_docks_available, CASE WHEN k >= 5 THEN true END AS is_installed, CASE WHEN k >= 5 THEN event_type <> 'signup' END AS is_renting, CASE WHEN k >= 5 THEN true END AS is_returning,
    CAST(station_id % 3 AS INTEGER) AS kafka_partition, event_id AS kafka_offset, k, releve_at FROM r"""
_REASON = "SELECT p.*, CASE WHEN k <= 5 THEN 'json_invalide_ou_station_id_absent' WHEN k = 6 THEN 'last_reported_absent' WHEN k = 7 THEN 'last_reported_par_defaut' WHEN k = 8 THEN 'last_reported_dans_le_futur' WHEN k = 9 THEN 'velos_negatifs' WHEN k = 10 THEN 'bornes_negatives' WHEN station_id NOT IN (SELECT s_suppkey FROM supplier) THEN 'station_inconnue' END AS rejection_reason FROM p"


def _lags(source: str, value: str, names: dict[str, int], columns: str) -> str:
    """The value k hours before, in one pass: a window of that one hour by the hour's number (hours of a station are there once)."""
    frame = lambda k: f"{abs(k)} {'PRECEDING' if k > 0 else 'FOLLOWING'}"
    told = ", ".join(f"max({value}) OVER (PARTITION BY station_id ORDER BY hour_number RANGE BETWEEN {frame(k)} AND {frame(k)}) AS {n}" for n, k in names.items())
    return f"SELECT {columns}, {told} FROM (SELECT *, epoch_us(heure_fin) // 3600000000 AS hour_number FROM {source}) a"


_FEATURES = {
    "hx": "SELECT h.station_id, heure_fin, CAST(velos_disponibles AS DOUBLE) AS v, velos_electriques, rate, latitude, longitude, est_paris FROM h JOIN s ON s.station_id = h.station_id WHERE tenths <= 14400 AND heure_fin BETWEEN TIMESTAMP '2024-01-01' AND " + AS_OF,
    "hl": _lags("hx", "v", {"l1": 1, "l2": 2, "l23": 23, "l167": 167, "nx": -1}, "a.* EXCLUDE (hour_number)"),
    "ft": """SELECT station_id, heure_fin, heure_fin + INTERVAL 1 HOUR AS target_time, CAST(extract(hour FROM heure_fin + INTERVAL 2 HOUR) AS DOUBLE) AS heure_cible, CAST(isodow(heure_fin + INTERVAL 2 HOUR) - 1 AS DOUBLE) AS jour_semaine_cible, CAST(CAST(isodow(heure_fin + INTERVAL 2 HOUR) >= 6 AS INTEGER) AS DOUBLE) AS est_weekend_cible, 0.0::DOUBLE AS est_ferie_cible,
        v AS velos_t0, l1 AS velos_lag_1h, l2 AS velos_lag_2h, l23 AS velos_cible_moins_24h, l167 AS velos_cible_moins_7j, (v + coalesce(l1, 0) + coalesce(l2, 0)) / CAST(1 + CAST(l1 IS NOT NULL AS INTEGER) + CAST(l2 IS NOT NULL AS INTEGER) AS DOUBLE) AS moyenne_3h, v - l1 AS tendance_1h, CASE WHEN v > 0 THEN CAST(velos_electriques AS DOUBLE) / v ELSE 0.0::DOUBLE END AS part_electriques,
        rate / 10000.0::DOUBLE AS taux_remplissage_t0, 99.0::DOUBLE AS capacite, latitude, longitude, CAST(CAST(est_paris AS INTEGER) AS DOUBLE) AS est_paris, nx AS velos_cible FROM hl""",
}
_SHARES = "SELECT CAST(count(*) AS BIGINT) AS c, CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2 WHEN o_totalprice < 300000 THEN 3 ELSE 4 END AS k FROM orders WHERE o_orderdate {0} TIMESTAMP '1997-01-01' GROUP BY 2"
_BINS = "SELECT b.k, coalesce(c, 0) / CAST((SELECT sum(c) FROM {0}) AS DOUBLE) AS s FROM (SELECT unnest(range(5)) AS k) b LEFT JOIN {0} x ON x.k = b.k"

_MONITORED = ("velos_t0", "taux_remplissage_t0", "part_electriques", "tendance_1h", "moyenne_3h")
_LONG = " UNION ALL ".join(f"SELECT '{n}' AS feature, {n} AS value, heure_fin >= {AS_OF} - INTERVAL 7 DAY AS is_new FROM ft WHERE {n} IS NOT NULL" for n in _MONITORED)
_POINTS = ", ".join(f"{k / 10}" for k in range(11))
_BIN = " + ".join(f"CAST(coalesce({k} < len(e.edges) AND e.edges[{k}] <= v.value, false) AS INTEGER)" for k in range(2, 11))  # inner edges up to the value
_DRIFT = f"""SELECT feature, round(p, 6) AS psi, p > 0.001 AS is_drift, CAST(n AS INTEGER) AS n_current FROM (
    SELECT b.feature, max(b.new_of) AS n, sum((greatest(b.new_n / b.new_of, 1e-4) - greatest(b.old_n / b.old_of, 1e-4)) * ln(greatest(b.new_n / b.new_of, 1e-4) / greatest(b.old_n / b.old_of, 1e-4))) AS p FROM (
        SELECT k.feature, k.bin, coalesce(sum(c.n) FILTER (WHERE NOT is_new), 0)::DOUBLE AS old_n, coalesce(sum(c.n) FILTER (WHERE is_new), 0)::DOUBLE AS new_n, max(k.old_of)::DOUBLE AS old_of, max(k.new_of)::DOUBLE AS new_of
        FROM (SELECT e.feature, unnest(range(len(e.edges) - 1)) AS bin, o.old_of, o.new_of FROM (
            SELECT feature, list_sort(list_distinct(quantile_cont(value, [{_POINTS}]))) AS edges FROM ({_LONG}) WHERE NOT is_new GROUP BY 1) e
            JOIN (SELECT feature, count(*) FILTER (WHERE NOT is_new) AS old_of, count(*) FILTER (WHERE is_new) AS new_of FROM ({_LONG}) GROUP BY 1) o ON o.feature = e.feature) k
        LEFT JOIN (SELECT v.feature, v.is_new, {_BIN} AS bin, count(*) AS n FROM ({_LONG}) v JOIN (
            SELECT feature, list_sort(list_distinct(quantile_cont(value, [{_POINTS}]))) AS edges FROM ({_LONG}) WHERE NOT is_new GROUP BY 1) e ON e.feature = v.feature GROUP BY 1, 2, 3) c
        ON c.feature = k.feature AND c.bin = k.bin GROUP BY 1, 2) b GROUP BY 1)"""
_CHECKED = f"""SELECT *, abs(num_bikes_available - num_mechanical - num_ebike) AS gap, (epoch_us({AS_OF}) - epoch_us(last_reported)) / 60e6 AS since, (epoch_us(releve_at) + kafka_offset % 100 * 60000000 - epoch_us(last_reported)) / 60e6 AS late,
    count(*) OVER (PARTITION BY station_id, last_reported) AS met FROM p"""


def _check(kind: str, column: str, wrong: str, mostly: float = 1.0, severity: str = "critical", base: str = "true", where: str = "true") -> str:
    """A check of rows: those of `base` are looked at, of which `wrong` ones break it."""
    return f"""SELECT '{kind}' AS expectation, '{column}' AS column_name, '{severity}' AS severity, count(*) FILTER (WHERE {where} AND ({wrong})) <= count(*) FILTER (WHERE {where} AND {base}) * (1 - {mostly}) + 1e-9 AS success,
        count(*) FILTER (WHERE {where} AND ({wrong})) AS unexpected_count, count(*) FILTER (WHERE {where}) AS element_count FROM q"""


def _between(column: str, low: str, high: str, value: str | None = None, **more) -> str:
    v = value or column
    return _check("between", column, f"{v} < {low} OR {v} > {high}", base=f"{v} IS NOT NULL", **more)


_SUITE = " UNION ALL ".join((
    "SELECT 'row_count' AS expectation, NULL AS column_name, 'critical' AS severity, count(*) >= 1 AS success, 0 AS unexpected_count, count(*) AS element_count FROM q",
    _check("not_null", "station_id", "station_id IS NULL"), _check("not_null", "last_reported", "last_reported IS NULL"), _check("unique", "station_id,last_reported", "met > 1"),
    _between("num_bikes_available", "0", "150"), _between("num_docks_available", "0", "150", where="coalesce(is_renting, false)"), _between("num_mechanical", "0", "1e9"), _between("num_ebike", "0", "1e9"),
    _between("bikes_type_gap", "0", "0", "gap", mostly=0.99, severity="warning"), _check("not_null", "station_code", "station_code IS NULL", 0.99, "warning"),
    "SELECT 'min_between', 'minutes_since_report', 'warning', coalesce(min(since) <= 180, false), 0, count(*) FROM q",
    _between("ingestion_delay_minutes", "-1e18", "90", "late", mostly=0.95, severity="warning"),
))

_HALF = "least(99.0::DOUBLE, greatest(0.0::DOUBLE, velos_t0 * 1.5 - 10))"
_PREDICTED = " UNION ALL ".join(f"SELECT station_id, heure_fin AS feature_time, target_time, {_HALF} AS predicted_bikes, 'availability' AS model_name, '{v}' AS model_version FROM ft WHERE heure_fin = (SELECT max(heure_fin) FROM ft WHERE heure_fin <= TIMESTAMP '{at}')" for at, v in (("2024-01-20", "1"), ("2024-01-20", "2"), ("2024-01-25", "1")))
_BINNED = " UNION ALL ".join(f"""SELECT '{v}' AS model_version, CAST(k.k AS INTEGER) AS k, round(max(k.e), 6) AS edge, round(count(x.velos_t0) / max(k.n)::DOUBLE, 6) AS share FROM (
    SELECT unnest(range(len(edges) - 1)) AS k, unnest(edges[:len(edges) - 1]) AS e, edges, n FROM (SELECT list_sort(list_distinct(quantile_cont(velos_t0, [{_POINTS}]))) AS edges, count(*) AS n FROM ft WHERE heure_fin < TIMESTAMP '{day}')) k
    LEFT JOIN (SELECT velos_t0 FROM ft WHERE heure_fin < TIMESTAMP '{day}') x ON (k.k = 0 OR x.velos_t0 >= k.e) AND (k.k = len(k.edges) - 2 OR x.velos_t0 < k.edges[k.k + 2]) GROUP BY k.k""" for v, day in (("1", "2024-01-24"), ("2", "2024-01-10")))
_OLD = "(SELECT velos_t0 AS v FROM ft WHERE heure_fin < TIMESTAMP '{old}')"
_DRIFTS = " UNION ALL ".join(f"""SELECT TIMESTAMP '{at}' AS computed_at, '{name}' AS model_name, 'velos_t0' AS feature, round(p, 6) AS psi, p > 0.001 AS is_drift, CAST(n AS INTEGER) AS n_current, true AS max_is_own FROM (
    SELECT max(nn) AS n, sum((greatest(b / nn, 1e-4) - greatest(a / an, 1e-4)) * ln(greatest(b / nn, 1e-4) / greatest(a / an, 1e-4))) AS p FROM (
        SELECT k.k, (SELECT count(*) FROM {_OLD.format(old=old)} WHERE (k.k = 0 OR v >= k.e) AND (k.last OR v < k.f))::DOUBLE AS a, (SELECT count(*) FROM {_OLD.format(old=old)})::DOUBLE AS an,
            (SELECT count(*) FROM (SELECT velos_t0 AS v FROM ft WHERE heure_fin BETWEEN TIMESTAMP '{at}' - INTERVAL 72 HOUR AND TIMESTAMP '{at}') WHERE (k.k = 0 OR v >= k.e) AND (k.last OR v < k.f))::DOUBLE AS b,
            (SELECT count(*) FROM ft WHERE heure_fin BETWEEN TIMESTAMP '{at}' - INTERVAL 72 HOUR AND TIMESTAMP '{at}')::DOUBLE AS nn
        FROM (SELECT unnest(range(len(edges) - 1)) AS k, unnest(edges[:len(edges) - 1]) AS e, unnest(edges[2:]) AS f, unnest(range(len(edges) - 1)) = len(edges) - 2 AS last FROM (
            SELECT list_sort(list_distinct(quantile_cont(v, [{_POINTS}]))) AS edges FROM {_OLD.format(old=old)})) k))""" for at, name, old in (("2024-01-27", "m", "2024-01-24"), ("2024-01-31", "m", "2024-01-24"), ("2024-01-31", "other", "2024-01-10")))
_FORECAST = f"""SELECT station_id, heure_fin AS feature_time, target_time, true AS in_range, CAST(15 AS INTEGER) AS trials, (SELECT round(avg(abs(velos_t0 - velos_cible)), 6) FROM held) AS baseline_mae, true AS not_worse FROM ft WHERE heure_fin = (SELECT max(heure_fin) FROM ft)"""
_HELD = {
    "told": "SELECT heure_fin, velos_t0, velos_cible FROM ft WHERE velos_cible IS NOT NULL",
    "ranked": "SELECT heure_fin, row_number() OVER (ORDER BY heure_fin DESC) AS n, count(*) OVER () AS o FROM (SELECT DISTINCT heure_fin FROM told)",
    "held": "SELECT * FROM told WHERE heure_fin >= (SELECT heure_fin FROM ranked WHERE n = greatest(1, CAST(round_even(o * 0.2, 0) AS INTEGER)))",
}

ORACLE_SQL: dict[str, str] = {
    "jdbc_round_trip": "SELECT event_id, user_id % 3 <> 2 AS is_known_station, c_name AS name, c_mktsegment AS segment FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 2 AND c_mktsegment <> 'BUILDING') ON c_custkey = user_id",
    "stream_unique": _with(("r",), "SELECT * FROM x UNION ALL SELECT DISTINCT station_id, releve_at FROM r WHERE k % 5 = 0", x="SELECT DISTINCT station_id, releve_at AS last_reported FROM r"),
    "stream_gauges": "SELECT count(*) AS n_rows, CAST(4 AS INTEGER) AS n_batches, CAST(0 AS INTEGER) AS n_behind, true AS has_rates FROM events",
    "geocode_places": _with(("st",), "SELECT station_id, CASE WHEN n % 10 <> 0 THEN 'Commune ' || CAST(n % 90 AS VARCHAR) END AS commune, CASE WHEN n % 10 <> 0 THEN CAST(92000 + n % 90 AS VARCHAR) END AS code_insee, (SELECT count(*) FROM (SELECT DISTINCT latitude, longitude FROM st WHERE station_id % 11 <> 0)) AS n_asked FROM (SELECT station_id, CAST(round((latitude - 48) * 1000) AS BIGINT) AS n FROM st WHERE station_id % 11 <> 0)"),
    "lookup_skipping": _with(("r",), "SELECT station_id, releve_at AS last_reported, k AS num_bikes_available, true AS few_files FROM r WHERE (station_id, releve_at) IN (SELECT station_id, max(releve_at) FROM r WHERE station_id = (SELECT min(station_id) FROM r) GROUP BY 1)"),
    "station_reference": """WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'Station ' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS name, c_custkey % 3 <> 0 AS first, c_custkey % 4 <> 1 AS second, c_custkey % 1000 AS n FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey % 4 <> 1)),
        y AS (SELECT *, CASE WHEN second THEN n + CASE WHEN k % 8 = 0 THEN 7 ELSE 0 END END AS new, CASE WHEN first THEN n END AS old FROM x),
        z AS (SELECT *, CASE WHEN new % 10 <> 0 THEN new WHEN old % 10 <> 0 THEN old END AS told FROM y)
        SELECT k AS station_id, name AS station_name, CAST(CASE WHEN second THEN 32 ELSE 31 END AS INTEGER) AS capacity, CASE WHEN told IS NOT NULL THEN 'Commune ' || CAST(told % 90 AS VARCHAR) END AS commune, CAST(92000 + told % 90 AS VARCHAR) AS code_insee,
        CASE WHEN first THEN DATE '2024-01-01' ELSE DATE '2024-01-02' END AS first_seen, CASE WHEN second THEN DATE '2024-01-02' ELSE DATE '2024-01-01' END AS last_seen FROM z""",
    "topic_newest": "SELECT CAST(p AS INTEGER) AS partition, count(user_id) AS high, max(ts) AS newest_at FROM (SELECT unnest(range(4)) AS p) LEFT JOIN events ON user_id % 3 = p GROUP BY p",
    "topic_messages": _with(("r",), "SELECT CAST(station_id AS VARCHAR) AS key, raw_json AS raw, CAST(station_id % 3 AS INTEGER) AS partition, releve_at AS timestamp, 'station_status' AS topic, true AS in_order FROM m", m=_MESSAGE),
    "feed_log": _with(("r",), "SELECT CAST(station_id AS VARCHAR) AS key, CAST(date_diff('day', DATE '2024-01-01', CAST(releve_at AS DATE)) AS BIGINT) AS polled, k AS bikes FROM r"),
    "forecast_search": _with(("h", "s"), _FORECAST, **_FEATURES, **_HELD),
    "stored_predictions": _with(("h", "s"), _PREDICTED, **_FEATURES),
    "stored_bins": _with(("h", "s"), _BINNED, **_FEATURES),
    "stored_drift": _with(("h", "s"), _DRIFTS, **_FEATURES),
    "window_lookback": "SELECT event_id AS kafka_offset FROM events WHERE ts >= TIMESTAMP '2024-01-10 11:30:00' AND ts < TIMESTAMP '2024-01-12'",
    "overwrite_table": "SELECT * FROM nation WHERE n_regionkey > 1",
    "merge_landing": _with(("r",), "SELECT DISTINCT station_id, releve_at AS last_reported, CAST(CASE WHEN k < 50 THEN k ELSE k + 1 END AS INTEGER) AS num_bikes_available, CAST(24 AS BIGINT) AS n_checks, true AS all_merged FROM r"),
    "table_columns": "SELECT table_name AS name, string_agg(column_name, ', ' ORDER BY ordinal_position) AS columns FROM information_schema.columns WHERE table_name IN ('region', 'orders') GROUP BY 1",
    "critical_stations": _critical(),
    "rank_empty_full": _critical("station_id, part_temps_vide, rang_vide, part_temps_pleine, rang_pleine"),
    "bronze_projection": _with(("r",), "SELECT CAST(station_id AS VARCHAR) AS kafka_key, raw_json, 'station_status' AS topic, CAST(station_id % 3 AS INTEGER) AS kafka_partition, event_id AS kafka_offset, releve_at AS kafka_timestamp FROM m", m=_MESSAGE),
    "parse_json": _with(("r",), "SELECT * EXCLUDE (k, releve_at) FROM p", p=_PARSED),
    "reject_reason": _with(("r",), "SELECT kafka_offset, rejection_reason FROM q", p=_PARSED, q=_REASON),
    "reject_counts": _with(("r",), "SELECT rejection_reason, count(*) AS n FROM q WHERE rejection_reason IS NOT NULL GROUP BY 1", p=_PARSED, q=_REASON),
    "known_flag_join": "SELECT event_id, user_id AS station_id, user_id IN (SELECT s_suppkey FROM supplier) AS is_known_station FROM events",
    "silver": _with(("r",), "SELECT station_id, last_reported, num_bikes_available, num_mechanical, num_ebike, num_docks_available, is_renting, kafka_offset, CAST(last_reported AS DATE) AS report_date FROM (SELECT *, row_number() OVER (PARTITION BY station_id, last_reported ORDER BY releve_at DESC, kafka_offset DESC) AS n FROM q WHERE rejection_reason IS NULL) WHERE n = 1", p=_PARSED, q=_REASON),
    "dedup_latest": "SELECT * EXCLUDE (n) FROM (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS n FROM lineitem) WHERE n = 1",
    "map_array_sum": _with(("r",), "SELECT event_id, CAST(k % 10 + 1 AS INTEGER) AS mechanical, CAST(k - k % 10 AS INTEGER) AS ebike, CAST(0 AS INTEGER) AS cargo FROM r"),
    "dim_hour": _with(("f",), "SELECT x.*, coalesce(n, 0) AS n_readings FROM (SELECT CAST(h AS INTEGER) AS heure, lpad(CAST(h AS VARCHAR), 2, '0') || 'h' AS libelle_heure, CASE WHEN h BETWEEN 6 AND 9 THEN 'matin' WHEN h BETWEEN 10 AND 13 THEN 'midi' WHEN h BETWEEN 14 AND 16 THEN 'après-midi' WHEN h BETWEEN 17 AND 20 THEN 'soir' ELSE 'nuit' END AS tranche_horaire, h IN (7, 8, 9, 17, 18, 19) AS est_heure_pointe FROM (SELECT unnest(range(24)) AS h)) x LEFT JOIN (SELECT heure, count(*) AS n FROM f GROUP BY 1) f ON f.heure = x.heure"),
    "dim_date": _with(("f",), f"SELECT j.*, coalesce(n, 0) AS n_readings FROM ({_days()}) j LEFT JOIN (SELECT date_id, count(*) AS n FROM f GROUP BY 1) f ON f.date_id = j.date_id"),
    "dim_station_zone": _with(("s",), "SELECT * FROM s"),
    "holiday_left_join": _with(("f",), f"SELECT annee, type_jour, count(*) AS n_days, count(nom_ferie) AS n_holidays, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_readings FROM ({_days()}) j LEFT JOIN (SELECT date_id, count(*) AS n FROM f GROUP BY 1) f ON f.date_id = j.date_id GROUP BY 1, 2"),
    "fact_availability": _with(("f",), "SELECT * EXCLUDE (rate), rate / 10000.0::DOUBLE AS taux_remplissage FROM f"),
    "reading_intervals": _with(("i",), "SELECT * FROM i"),
    "latest_state": _with(("f",), "SELECT station_id, releve_at, velos_disponibles, est_installee FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY releve_at DESC) AS n FROM f) WHERE n = 1"),
    "state_classification": _with(
        ("s", "f"),
        f"SELECT s.station_id, nom_station, zone, commune, arrondissement, est_paris, latitude, longitude, capacite, releve_at AS dernier_releve_at, {_half_up(f'(epoch_us({AS_OF}) - epoch_us(releve_at))', '60000000', 10)} AS minutes_depuis_releve, velos_disponibles, velos_mecaniques, velos_electriques, bornes_libres, rate / 10000.0::DOUBLE AS taux_remplissage, CASE WHEN NOT est_installee OR NOT location_active THEN 'hors service' WHEN est_vide THEN 'vide' WHEN est_pleine THEN 'pleine' WHEN rate < 2000 THEN 'presque vide' WHEN rate > 8000 THEN 'presque pleine' ELSE 'disponible' END AS statut FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY releve_at DESC) AS n FROM f) x JOIN s ON s.station_id = x.station_id WHERE n = 1",
    ),
    "hourly_forward_fill": _with(("h",), f"SELECT {HOURS} FROM h"),
    "hourly_fill_by_grid": _with(("h",), "SELECT station_id, heure_debut, dernier_releve_at, velos_disponibles FROM h"),
    "hourly_grid": _with(("g",), "SELECT heure_debut, count(DISTINCT station_id) AS n_stations, count(*) AS n_rows, CAST(sum(station_id) AS BIGINT) AS sum_ids FROM g GROUP BY 1"),
    "hourly_incremental": _with(("h",), "SELECT station_id, heure_debut, velos_disponibles, tenths / 10.0::DOUBLE AS minutes_depuis_releve FROM h WHERE heure_debut >= TIMESTAMP '2024-01-19 21:00:00'"),
    "zone_hourly": _with(("h", "s"), f"SELECT heure_debut, date_id, heure_locale AS heure, zone, commune, est_paris, count(*) AS nb_stations, CAST(sum(velos_disponibles) AS BIGINT) AS velos_disponibles, CAST(sum(velos_mecaniques) AS BIGINT) AS velos_mecaniques, CAST(sum(velos_electriques) AS BIGINT) AS velos_electriques, CAST(sum(bornes_libres) AS BIGINT) AS bornes_libres, {_half_up('sum(rate)', 'count(*)', 1)} / 10000.0::DOUBLE AS taux_remplissage_moyen, count(*) FILTER (WHERE velos_disponibles = 0) AS nb_stations_vides, count(*) FILTER (WHERE bornes_libres = 0) AS nb_stations_pleines FROM h JOIN s ON s.station_id = h.station_id GROUP BY ALL"),
    "hourly_profile": _with(("h", "s"), f"SELECT h.station_id, nom_station, zone, type_jour, heure_locale AS heure, {_half_up('sum(rate)', 'count(*)', 1)} / 10000.0::DOUBLE AS taux_remplissage_moyen, {_half_up('sum(velos_disponibles)', 'count(*)', 100)} AS velos_disponibles_moyen, {_half_up('sum(velos_mecaniques)', 'count(*)', 100)} AS velos_mecaniques_moyen, {_half_up('sum(velos_electriques)', 'count(*)', 100)} AS velos_electriques_moyen, count(*) AS nb_heures_observees FROM h JOIN dd ON dd.date_id = h.date_id JOIN s ON s.station_id = h.station_id GROUP BY h.station_id, nom_station, zone, type_jour, heure_locale", dd=_days()),
    "time_shift_lags": _with(("h",), _lags("hx", "velos_disponibles", {"lag_1": 1, "lag_2": 2, "lag_23": 23, "lag_167": 167, "next_1": -1}, "a.* EXCLUDE (hour_number)"), hx="SELECT station_id, heure_fin, velos_disponibles FROM h"),
    "feature_matrix": _with(("h", "s"), "SELECT * REPLACE (round(moyenne_3h, 6) AS moyenne_3h, round(part_electriques, 6) AS part_electriques, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude) FROM ft", **_FEATURES),
    "temporal_split": _with(("h",), "SELECT count(*) AS n, max(heure_fin) AS newest, CASE WHEN heure_fin < (SELECT c FROM cut) THEN 'train' ELSE 'test' END AS part FROM h GROUP BY 3", x="SELECT heure_fin, row_number() OVER (ORDER BY heure_fin DESC) AS n, count(*) OVER () AS o FROM (SELECT DISTINCT heure_fin FROM h)", cut="SELECT heure_fin AS c FROM x WHERE n = greatest(1, CAST(round_even(o * 0.2, 0) AS INTEGER))"),
    "decile_edges": "SELECT 'o_totalprice' AS feature, CAST(k AS INTEGER) AS k, round(e, 4) AS edge FROM (SELECT unnest(range(11)) AS k, unnest(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')",
    "bin_shares": f"WITH x AS ({_SHARES.format('<')}), y AS ({_BINS.format('x')}) SELECT 'o_totalprice' AS feature, CAST((SELECT sum(c) FROM x) AS BIGINT) AS n, CAST(k AS INTEGER) AS k, round(s, 9) AS share FROM y",
    "psi": f"WITH x AS ({_SHARES.format('<')}), z AS ({_SHARES.format('>=')}), e AS ({_BINS.format('x')}), a AS ({_BINS.format('z')}), t AS (SELECT sum((greatest(a.s, 1e-4) - greatest(e.s, 1e-4)) * ln(greatest(a.s, 1e-4) / greatest(e.s, 1e-4))) AS p FROM e JOIN a ON a.k = e.k) SELECT 'o_totalprice' AS feature, round(p, 9) AS psi, 0.2::DOUBLE AS threshold, p > 0.2 AS is_drift, CAST((SELECT sum(c) FROM z) AS INTEGER) AS n_current FROM t",
    "drift_features": _with(("h", "s"), _DRIFT, **_FEATURES),
    "prediction_vs_actual": _with(("h", "s"), "SELECT p.station_id, nom_station, zone, t AS heure_cible, p.heure_fin AS heure_donnees, version AS version_modele, CAST(predicted AS DOUBLE) AS velos_predits, h.velos_disponibles AS velos_reels, CAST(abs(predicted - h.velos_disponibles) AS DOUBLE) AS erreur_absolue, h.velos_disponibles IS NOT NULL AS est_evaluee FROM (SELECT station_id, heure_fin, heure_fin + INTERVAL 1 HOUR AS t, CASE WHEN station_id % 2 = 0 THEN velos_disponibles + 1 ELSE velos_disponibles END AS predicted, CASE WHEN station_id % 2 = 0 THEN '2' ELSE '1' END AS version FROM h) p JOIN s ON s.station_id = p.station_id LEFT JOIN h ON h.station_id = p.station_id AND h.heure_fin = p.t"),
    "baseline_metrics": _with(("h", "s"), "SELECT round(avg(abs(velos_t0 - velos_cible)), 9) AS mae, round(sqrt(avg((velos_t0 - velos_cible) * (velos_t0 - velos_cible))), 9) AS rmse FROM ft WHERE velos_cible IS NOT NULL", **_FEATURES),
    "merge_insert_absent": _with(("r",), "SELECT station_id, releve_at AS last_reported, CAST(releve_at AS DATE) AS report_date, CAST(CASE WHEN k % 3 <> 0 THEN k ELSE k + 1000 END AS INTEGER) AS num_bikes_available FROM r"),
    "upsert_scd1": "SELECT c_custkey AS station_id, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' new' ELSE c_name END AS station_name, CASE WHEN c_custkey % 4 = 0 THEN 'moved' WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS commune, CASE WHEN c_custkey % 3 <> 0 THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS first_seen, CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS last_seen FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
    "delete_insert": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders",
    "quality_suite": _with(("r",), _SUITE, p=_PARSED, q=_CHECKED),
    "quarantine_replay": _with(("r",), "SELECT kafka_partition, kafka_offset, rejection_reason, CASE WHEN kafka_offset % 3 <> 0 THEN DATE '2024-02-01' ELSE DATE '2024-02-02' END AS quarantine_date FROM q WHERE rejection_reason IS NOT NULL", p=_PARSED, q=_REASON.replace("WHEN station_id NOT IN (SELECT s_suppkey FROM supplier) THEN 'station_inconnue' ", "")),
    "constraint_tests": """SELECT (SELECT count(*) FROM orders WHERE o_orderdate IS NULL) AS n_broken, 'not_null' AS test UNION ALL SELECT (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), 'unique' UNION ALL SELECT (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')), 'accepted_values' UNION ALL SELECT (SELECT count(*) FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45), 'accepted_range'
        UNION ALL SELECT (SELECT count(*) FROM lineitem WHERE l_quantity <= 5 OR l_quantity >= 45), 'accepted_range_open' UNION ALL SELECT (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)), 'relationships' UNION ALL SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), 'relationships_ok'""",
    "source_freshness": f"SELECT max(ts) AS newest, round((epoch_us({AS_OF}) - epoch_us(max(ts))) / 60e6, 6) AS age_minutes, CASE WHEN (epoch_us({AS_OF}) - epoch_us(max(ts))) / 60e6 <= 30 THEN 'pass' WHEN (epoch_us({AS_OF}) - epoch_us(max(ts))) / 60e6 <= 120 THEN 'warn' ELSE 'error' END AS status FROM events",
    "alerts": """WITH RECURSIVE a AS (SELECT DISTINCT event_type AS alert_type, CAST(user_id % 5 AS VARCHAR) AS title, ts FROM events), w AS (SELECT alert_type, title, min(ts) AS created_at FROM a GROUP BY 1, 2
        UNION ALL SELECT w.alert_type, w.title, (SELECT min(a.ts) FROM a WHERE a.alert_type = w.alert_type AND a.title = w.title AND a.ts >= w.created_at + INTERVAL 720 MINUTE) FROM w WHERE w.created_at IS NOT NULL) SELECT alert_type, title, created_at FROM w WHERE created_at IS NOT NULL""",
    "parse_stations": "SELECT c_custkey AS station_id, 'x' AS station_code, CASE WHEN c_custkey % 3 = 0 THEN 'Station ' || CAST(c_custkey AS VARCHAR) ELSE trim(c_name) END AS station_name, c_acctbal AS lat, 2.0::DOUBLE AS lon, CAST(30 AS INTEGER) AS capacity FROM customer WHERE c_custkey % 7 <> 0",
    "changed_batch": _with(("r",), "SELECT station_id, CAST(k AS BIGINT) AS last_reported, epoch_us(releve_at) AS seq, event_type AS value FROM (SELECT *, lag(k) OVER (PARTITION BY station_id ORDER BY releve_at) AS b FROM r) WHERE b IS DISTINCT FROM k"),
}
ORACLE_SQL["stream_cdc"] = ORACLE_SQL["changed_batch"]
ORACLE_SQL["stream_bronze"] = ORACLE_SQL["bronze_projection"]
_STATE = ORACLE_SQL["state_classification"]
ORACLE_SQL["nearest_stations"] = f"SELECT station_id, nom_station AS station, zone, CAST(round(2 * 6371000 * asin(sqrt(pow(sin(radians(latitude - 48.05) / 2), 2) + cos(radians(48.05)) * cos(radians(latitude)) * pow(sin(radians(longitude - 2.3) / 2), 2)))) AS BIGINT) AS distance_m, velos_disponibles AS velos, velos_mecaniques AS mecaniques, velos_electriques AS electriques, bornes_libres, statut FROM ({_STATE}) WHERE statut <> 'hors service' AND velos_disponibles > 0 ORDER BY distance_m, station_id LIMIT 5"
ORACLE_SQL["guarded_sql"] = f"SELECT statut, count(*) AS n, CAST(sum(velos_disponibles) AS BIGINT) AS velos FROM ({_STATE}) GROUP BY statut"
