"""The named queries again as plain SQL, for checking results against another engine.

Written from the definition of each report, not from the Spark plans: running totals
are ordinary windows, transactions ordinary groups.
"""

from __future__ import annotations

from tallyframe.sources.tables import ASSERTION_BASE, INCOME_BASE, LAST_LEG

MONEY = "DECIMAL(28,2)"

BOOKS = f"""
WITH ord AS MATERIALIZED (
    SELECT o_orderkey, o_orderkey + 1 AS tindex, CAST(o_orderdate AS DATE) AS date, c_name AS customer,
           o_orderpriority AS priority, c_mktsegment AS segment,
           CASE o_orderstatus WHEN 'F' THEN 'Cleared' WHEN 'P' THEN 'Pending' ELSE 'Unmarked' END AS status,
           CAST(o_totalprice AS DECIMAL(18,2)) AS total,
           CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'UAH' ELSE 'CHF' END
               AS commodity
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
line AS MATERIALIZED (
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
    FROM lineitem
),
head AS MATERIALIZED (
    SELECT ord.*, s.line_total
    FROM ord LEFT JOIN (SELECT l_orderkey, sum(amount) AS line_total FROM line GROUP BY l_orderkey) s
        ON o_orderkey = l_orderkey
),
buy AS MATERIALIZED (
    SELECT event_id + {INCOME_BASE} AS tindex, CAST(ts AS DATE) AS date, user_id, CAST(value AS DECIMAL(18,2)) AS value
    FROM events WHERE event_type = 'purchase'
),
txn AS MATERIALIZED (
    SELECT tindex, date, CASE WHEN line_total IS NULL THEN 'Internal Transfer' ELSE customer END AS payee,
           priority AS note, status, segment, priority FROM head
    UNION ALL
    SELECT tindex, date, 'User ' || user_id, '', 'Cleared', NULL, NULL FROM buy
),
legs AS MATERIALIZED (
    SELECT tindex, l_linenumber AS leg, date, 'Expenses:' || p_type || ':' || p_brand AS account, commodity, amount
    FROM line JOIN ord ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    UNION ALL
    SELECT tindex, {LAST_LEG}, date,
           CASE status WHEN 'Pending' THEN 'Liabilities:Card:' ELSE 'Assets:Bank:' END || segment, commodity,
           -coalesce(line_total, total) FROM head
    UNION ALL
    SELECT tindex, 1, date, 'Assets:Savings', commodity, total FROM head WHERE line_total IS NULL
    UNION ALL
    SELECT tindex, 1, date, 'Assets:Cash', 'USD', value FROM buy
    UNION ALL
    SELECT tindex, 2, date, 'Income:Sales', 'USD', -value FROM buy
),
post AS MATERIALIZED (
    SELECT tindex, CAST(leg AS INTEGER) AS leg, date, account, commodity, CAST(amount AS {MONEY}) AS quantity FROM legs
),
price AS MATERIALIZED (
    SELECT CAST(date '1995-01-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS date, q.c AS commodity,
           CAST(q.p AS DECIMAL(18,8)) AS price, q.t AS target
    FROM (SELECT i, i + 12 * 1995 AS k FROM range(360) r(i)),
    LATERAL (VALUES ('GBP', 1.10 + (k % 10) * 0.01, 'EUR'), ('USD', CASE WHEN k % 2 = 0 THEN 40.0 ELSE 25.0 END, 'UAH'),
                    ('EUR', 1.05 + (k % 20) * 0.01, 'USD')) q(c, p, t)
),
asrt AS MATERIALIZED (
    SELECT event_id + {ASSERTION_BASE} AS tindex, CAST(ts AS DATE) AS date,
           CASE event_type WHEN 'signup' THEN 'Assets:Cash' ELSE 'Assets:Wallet:' || (user_id % 10) END AS account,
           CAST(CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END AS {MONEY})
               AS quantity,
           'USD' AS commodity
    FROM events WHERE event_type IN ('signup', 'error')
),
now AS MATERIALIZED (SELECT * FROM post WHERE date <= date '2001-08-01')
"""

ORACLES: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    ORACLES[name] = BOOKS + body


def total(column: str = "quantity") -> str:
    return f"CAST(sum({column}) AS {MONEY})"


def balances(where: str = "true", source: str = "post", account: str = "account", sign: str = "") -> str:
    return f"""SELECT {account} AS account, commodity, CAST({sign}sum(quantity) AS {MONEY}) AS amount FROM {source}
    WHERE {where} GROUP BY ALL HAVING sum(quantity) <> 0"""


def place(order: str) -> str:
    return f"row_number() OVER (ORDER BY {order}) AS position"


def heads(where: str, columns: str = "tindex, date, payee, note, status") -> str:
    return f"SELECT {columns} FROM txn WHERE {where}"


TWO = "array_to_string(list_slice(string_split(account, ':'), 1, 2), ':')"
ONE = "split_part(account, ':', 1)"
KIND = f"""CASE WHEN regexp_matches(account, '^income(:|$)', 'i') THEN 'Revenues'
    WHEN regexp_matches(account, '^expenses(:|$)', 'i') THEN 'Expenses'
    WHEN regexp_matches(account, '^assets(:|$)', 'i') THEN 'Assets'
    WHEN regexp_matches(account, '^liabilities(:|$)', 'i') THEN 'Liabilities' END"""

# -- balances ----------------------------------------------------------------

sql("bal", balances())
sql("bal_depth", balances(account=ONE))


def periodic(name: str, unit: str, where: str = "true", account: str = "account", sign: str = "") -> None:
    sql(
        name,
        f"""SELECT {account} AS account, commodity, CAST(date_trunc('{unit}', date) AS DATE) AS period,
        CAST({sign}sum(quantity) AS {MONEY}) AS amount FROM post WHERE {where} GROUP BY ALL""",
    )


periodic("bal_daily", "day")
periodic("bal_weekly", "week", account=TWO)
periodic("bal_monthly", "month")
periodic("bal_quarterly", "quarter", account=ONE)
periodic("bal_yearly", "year", account=TWO, sign="-")
sql(
    "bal_monthly_filled",
    f""", sums AS (
        SELECT account, commodity, CAST(date_trunc('month', date) AS DATE) AS period, {total()} AS amount
        FROM post GROUP BY ALL),
    spine AS (
        SELECT a.account, a.commodity, CAST(m AS DATE) AS period
        FROM (SELECT DISTINCT account, commodity FROM sums) a,
             generate_series(date '1995-01-01', date '2024-12-01', INTERVAL 1 MONTH) g(m))
    SELECT account, commodity, period, coalesce(amount, 0) AS amount FROM spine LEFT JOIN sums USING (account, commodity, period)""",
)
sql(
    "bal_pivot",
    f"SELECT {TWO} AS account, commodity, "
    + ", ".join(
        f"CAST(coalesce(sum(quantity) FILTER (year(date) = {y}), 0) AS {MONEY}) AS y{y}" for y in range(1995, 2025)
    )
    + " FROM post GROUP BY ALL",
)
sql("invert", balances("regexp_matches(account, '^income|^liab', 'i')", source="post", sign="-"))


def statement(name: str, sections: tuple[str, str], flipped: str, minus: str) -> None:
    sql(
        name,
        f""", r AS (
            SELECT {KIND} AS section, account, commodity,
                   CAST(CASE WHEN {KIND} = '{flipped}' THEN -sum(quantity) ELSE sum(quantity) END AS {MONEY}) AS amount
            FROM post WHERE {KIND} IN {sections} GROUP BY account, commodity HAVING sum(quantity) <> 0)
        SELECT section, account, commodity, amount, 'account' AS kind FROM r
        UNION ALL SELECT section, '', commodity, {total('amount')}, 'total' FROM r GROUP BY section, commodity
        UNION ALL SELECT 'Net', '', commodity, {total(f"CASE WHEN section = '{minus}' THEN -amount ELSE amount END")}, 'net'
        FROM r GROUP BY commodity""",
    )


statement("income_statement", ("Revenues", "Expenses"), "Revenues", "Expenses")
statement("balance_sheet", ("Assets", "Liabilities"), "Liabilities", "Liabilities")

HELD = f"""held AS (
    SELECT account, commodity, m AS period,
           (SELECT sum(quantity) FROM now n WHERE n.account = s.account AND n.commodity = s.commodity
            AND n.date < m + INTERVAL 1 MONTH) AS amount
    FROM (SELECT account, commodity, date_trunc('month', min(date)) AS first FROM now
          WHERE regexp_matches(account, '^(assets|liabilities)', 'i') GROUP BY ALL) s,
         generate_series(timestamp '1995-01-01', timestamp '2001-08-01', INTERVAL 1 MONTH) g(m)
    WHERE m >= first)"""
sql(
    "bs_monthly",
    f", {HELD} SELECT account, commodity, CAST(period AS DATE) AS period, CAST(amount AS {MONEY}) AS amount FROM held WHERE amount <> 0",
)
sql(
    "bs_monthly_checkpoint",
    f""", {HELD} SELECT account, commodity, CAST(period AS DATE) AS period, CAST(amount AS {MONEY}) AS amount FROM held
    WHERE amount <> 0 AND period >= date '1998-01-01'""",
)
sql(
    "stats",
    """, t AS (SELECT *, date > date '2001-08-01' - 30 AND date <= date '2001-08-01' AS in30,
               date > date '2001-08-01' - 7 AND date <= date '2001-08-01' AS in7 FROM txn)
    SELECT 'transactions' AS item, CAST(count(*) AS VARCHAR) AS value FROM t
    UNION ALL SELECT 'first_date', CAST(min(date) AS VARCHAR) FROM t
    UNION ALL SELECT 'last_date', CAST(max(date) AS VARCHAR) FROM t
    UNION ALL SELECT 'span_days', CAST(max(date) - min(date) + 1 AS VARCHAR) FROM t
    UNION ALL SELECT 'per_day', printf('%.1f', count(*) / CAST(max(date) - min(date) + 1 AS DOUBLE)) FROM t
    UNION ALL SELECT 'last_30_days', CAST(count(*) FILTER (in30) AS VARCHAR) FROM t
    UNION ALL SELECT 'last_7_days', CAST(count(*) FILTER (in7) AS VARCHAR) FROM t
    UNION ALL SELECT 'payees', CAST(count(DISTINCT payee) AS VARCHAR) FROM t
    UNION ALL SELECT 'accounts', CAST(count(DISTINCT account) AS VARCHAR) FROM post
    UNION ALL SELECT 'account_depth', CAST(max(len(string_split(account, ':'))) AS VARCHAR) FROM post
    UNION ALL SELECT 'commodities', CAST(count(DISTINCT commodity) AS VARCHAR) FROM post
    UNION ALL SELECT 'prices', CAST(count(*) AS VARCHAR) FROM price""",
)
sql("txn_count", "SELECT count(*) AS transactions FROM txn")
sql(
    "merge_amounts",
    f""", m AS (SELECT tindex, {ONE} AS kind, commodity, {total()} AS quantity, max(leg) AS precision, min(leg) AS first_seen
        FROM post GROUP BY ALL),
    w AS (SELECT *, count(*) FILTER (quantity <> 0) OVER k AS moving, min(first_seen) OVER k AS earliest FROM m
          WINDOW k AS (PARTITION BY tindex, kind))
    SELECT * EXCLUDE (moving, earliest) FROM w WHERE quantity <> 0 OR (moving = 0 AND first_seen = earliest)""",
)

# -- report predicates -------------------------------------------------------

LINES = "(SELECT post.*, payee, note, status, segment, priority FROM post JOIN (SELECT * EXCLUDE (date) FROM txn) USING (tindex))"
sql("q_account", balances("regexp_matches(account, 'brand#1[0-4]$|bank', 'i')"))
sql("q_desc", balances("regexp_matches(payee || ' | ' || note, '00[0-9] . [12]-', 'i')", source=LINES))
sql("q_payee", balances("regexp_matches(payee, '^customer#0+[0-9]{2}$', 'i')", source=LINES))
sql("q_amount", balances("abs(quantity) >= 90000 AND account LIKE 'Expenses%'"))
sql("q_amount_signed", balances("quantity < -90000"))
sql("q_tag", balances("segment IN ('MACHINERY', 'BUILDING')", source=LINES))
sql("q_status", balances("status = 'Pending'", source=LINES))
sql("q_window", balances("date >= date '1996-02-01' AND date < date '1996-05-01'"))
sql(
    "q_no_future",
    balances("(account LIKE 'Income%' OR account LIKE 'Assets:Cash%') AND date <= date '2024-01-15'", source="post"),
)
sql("q_date_prefix", heads("year(date) = 1997 AND month(date) = 6"))
sql(
    "q_txn_and",
    heads(
        """regexp_matches(payee || ' | ' || note, 'transfer . [1-3]-', 'i') AND status = 'Cleared'
        AND EXISTS (SELECT 1 FROM post p WHERE p.tindex = txn.tindex AND p.account = 'Assets:Savings')
        AND EXISTS (SELECT 1 FROM post p WHERE p.tindex = txn.tindex AND abs(p.quantity) > 200000)""",
        "tindex, date, payee, note",
    ),
)
sql(
    "header_postings",
    """SELECT p.tindex, p.date, payee, note, status AS txn_status, account, commodity, quantity
    FROM post p JOIN txn t ON p.tindex = t.tindex""",
)
sql(
    "print",
    """SELECT p.tindex, p.date, payee, note, status AS txn_status, leg, account, commodity, quantity
    FROM post p JOIN txn t ON p.tindex = t.tindex
    WHERE year(p.date) = 1998 AND p.tindex IN (SELECT tindex FROM post WHERE account LIKE '%:Brand#7')""",
)

# -- registers and running totals --------------------------------------------

sql(
    "reg",
    f"""SELECT tindex, leg, date, account, commodity, quantity AS amount,
    CAST(sum(quantity) OVER (PARTITION BY commodity ORDER BY date, tindex, leg, account, quantity
        ROWS UNBOUNDED PRECEDING) AS {MONEY}) AS total FROM post""",
)
sql(
    "reg_monthly",
    f""", s AS (SELECT {TWO} AS account, commodity, CAST(date_trunc('month', date) AS DATE) AS period,
        {total()} AS amount FROM post GROUP BY ALL)
    SELECT *, CAST(sum(amount) OVER (PARTITION BY commodity ORDER BY period, account ROWS UNBOUNDED PRECEDING)
        AS {MONEY}) AS total FROM s""",
)
sql(
    "aregister",
    f""", c AS (SELECT tindex, date, commodity, {total()} AS change FROM post
        WHERE account = 'Assets:Bank' OR account LIKE 'Assets:Bank:%' GROUP BY ALL),
    r AS (SELECT *, CAST(sum(change) OVER (PARTITION BY commodity ORDER BY date, tindex ROWS UNBOUNDED PRECEDING)
        AS {MONEY}) AS balance FROM c),
    o AS (SELECT tindex, string_agg(account, ', ' ORDER BY account) AS other_accounts
        FROM (SELECT DISTINCT tindex, account FROM post WHERE account NOT LIKE 'Assets:Bank:%') GROUP BY tindex)
    SELECT r.tindex, r.date, payee, coalesce(other_accounts, '') AS other_accounts, commodity, change, balance
    FROM r JOIN txn ON txn.tindex = r.tindex LEFT JOIN o ON o.tindex = r.tindex WHERE r.date >= date '1998-01-01'""",
)
ORACLES["aregister_checkpoint"] = ORACLES["aregister"]
CHECKED = f""", e AS (
    SELECT date, tindex, 1 AS leg, 0 AS late, account, commodity, quantity, NULL AS asserted FROM post
    WHERE (account, commodity) IN (SELECT (account, commodity) FROM asrt)
    UNION ALL SELECT date, tindex, 1, 1, account, commodity, 0, quantity FROM asrt),
checked AS (SELECT *, CAST(sum(quantity) OVER (PARTITION BY account, commodity ORDER BY date, tindex, leg, late, quantity
    ROWS UNBOUNDED PRECEDING) AS {MONEY}) AS balance FROM e)"""
sql(
    "assertion_check",
    CHECKED
    + f""" SELECT tindex, date, account, commodity, balance, CAST(asserted AS {MONEY}) AS asserted, balance = asserted AS holds
    FROM checked WHERE late = 1""",
)
sql(
    "failed_assertions",
    CHECKED
    + f""" SELECT tindex, date, account, commodity, balance, CAST(asserted AS {MONEY}) AS asserted
    FROM checked WHERE late = 1 AND balance <> asserted""",
)
LAST = """lst AS (SELECT account, date AS asserted_on, quantity AS asserted_quantity, commodity AS asserted_commodity
    FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY date DESC, tindex) AS n FROM asrt) WHERE n = 1)"""
sql("last_asserted", f", {LAST} SELECT *, 2 AS asserted_precision FROM lst")

# -- prices ------------------------------------------------------------------

INFERRED = """inf AS (SELECT CAST(l_shipdate AS DATE) AS date, 'PART' || l_partkey AS commodity, 'USD' AS target,
    CAST(round(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) / l_quantity + 1e-9, 2) AS DECIMAL(18,2)) AS price,
    l_orderkey * 8 + l_linenumber AS seq FROM lineitem WHERE l_quantity > 0)"""
sql(
    "prices_all",
    f""", {INFERRED} SELECT date, commodity, CAST(price AS DECIMAL(18,4)) AS price, target, 'declared' AS source FROM price
    UNION ALL SELECT date, commodity, price, target, 'inferred' FROM inf""",
)
sql(
    "prices_latest",
    f""", {INFERRED}, every AS (
        SELECT date, commodity, target, CAST(price AS DECIMAL(18,4)) AS price, 'declared' AS source, 0 AS seq FROM price
        UNION ALL SELECT date, commodity, target, price, 'inferred', seq FROM inf)
    SELECT commodity, target, price, date, source FROM (
        SELECT *, row_number() OVER (PARTITION BY commodity, target ORDER BY date DESC, source, seq DESC, price DESC) AS n FROM every)
    WHERE n = 1""",
)
sql("base_commodity", f", {INFERRED} SELECT 'USD' AS base_commodity, 'all' AS \"of\" UNION ALL SELECT max(target), 'inferred' FROM inf")
sql(
    "price_asof",
    f""", {INFERRED}, d AS (SELECT commodity, target, date, max(price) AS price FROM inf GROUP BY ALL),
    want AS (SELECT l_orderkey, 'PART' || l_partkey AS commodity, CAST(o_orderdate AS DATE) AS date,
             CAST(l_quantity AS INTEGER) AS units FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, w.commodity, w.date, units, target, price, d.date AS price_date
    FROM want w ASOF LEFT JOIN d ON w.commodity = d.commodity AND w.date >= d.date""",
)


def rate_table(name: str, asof: str) -> str:
    """Rates toward USD at a date expression over a table of dates ``days(d)``."""
    latest = (
        lambda c, t: f"(SELECT CAST(arg_max(price, date) AS DOUBLE) FROM price "  # noqa: E731
        f"WHERE commodity = '{c}' AND target = '{t}' AND date <= {asof})"
    )
    return f"""{name} AS (
        SELECT d, 'EUR' AS commodity, {latest('EUR', 'USD')} AS rate, 1 AS hops, 0 AS turns FROM days
        UNION ALL SELECT d, 'GBP', {latest('GBP', 'EUR')} * {latest('EUR', 'USD')}, 2, 0 FROM days
        UNION ALL SELECT d, 'UAH', 1.0 / {latest('USD', 'UAH')}, 1, 1 FROM days)"""


sql(
    "price_graph",
    f""", used AS (SELECT DISTINCT commodity, CAST(date_trunc('year', date) AS DATE) AS period FROM post),
    days AS (SELECT DISTINCT period AS d FROM used WHERE period <= date '2001-08-01'),
    {rate_table('rates', "least(d + INTERVAL 1 YEAR - INTERVAL 1 DAY, date '2001-08-01')")}
    SELECT used.commodity, period, round(rate, 8) AS rate, CAST(hops AS INTEGER) AS hops, CAST(turns AS INTEGER) AS turns
    FROM used LEFT JOIN rates ON used.commodity = rates.commodity AND period = d""",
)
VALUED = f""", days AS (SELECT date '2001-08-01' AS d), {rate_table('rates', 'd')},
sheet AS (SELECT {KIND} AS section, account, commodity,
    CASE WHEN {KIND} = 'Liabilities' THEN -1 ELSE 1 END * sum(quantity) AS amount FROM post
    WHERE {KIND} IN ('Assets', 'Liabilities') GROUP BY account, commodity HAVING sum(quantity) <> 0),
both_ AS (
    SELECT section, account, 'native' AS measure, commodity, CAST(amount AS DECIMAL(28,8)) AS exact, NULL::DOUBLE AS priced FROM sheet
    UNION ALL
    SELECT section, account, 'value', CASE WHEN rate IS NULL THEN sheet.commodity ELSE 'USD' END, NULL,
           CAST(amount AS DOUBLE) * coalesce(rate, 1.0) FROM sheet LEFT JOIN rates ON sheet.commodity = rates.commodity)"""
FIGURE = f"coalesce(CAST(sum(exact) AS {MONEY}), CAST(sum(priced) AS {MONEY}))"
sql(
    "valued_sheet",
    VALUED
    + f""" SELECT 'account' AS kind, section, account, measure, commodity, {FIGURE} AS amount FROM both_ GROUP BY ALL
    UNION ALL SELECT 'total', section, '', measure, commodity, {FIGURE} FROM both_ GROUP BY section, measure, commodity
    UNION ALL SELECT 'net', 'Net', '', measure, commodity, {FIGURE} FROM (
        SELECT section, measure, commodity, CASE WHEN section = 'Liabilities' THEN -exact ELSE exact END AS exact,
               CASE WHEN section = 'Liabilities' THEN -priced ELSE priced END AS priced FROM both_) GROUP BY measure, commodity""",
)
TEXT = "format('{:,.2f}', CAST(amount AS DOUBLE)) || ' ' || commodity"
SHEET = (
    VALUED
    + f""", {LAST}, f AS (SELECT section, account, measure, commodity, {FIGURE} AS amount FROM both_ GROUP BY ALL),
g AS (SELECT section, account, measure, string_agg({TEXT}, ', ' ORDER BY commodity) AS txt, arg_min(amount, commodity) AS lead
      FROM f GROUP BY ALL),
net_sheet AS (SELECT n.section, n.account, n.txt AS holding_text,
    CASE WHEN n.txt <> v.txt THEN '~' ELSE '' END || v.txt AS value_text, n.lead AS holding, v.lead AS value,
    asserted_on, asserted_quantity, asserted_commodity
    FROM g n JOIN g v ON n.account = v.account AND n.section = v.section AND n.measure = 'native' AND v.measure = 'value'
    LEFT JOIN lst ON lst.account = n.account)"""
)
sql("sheet_with_assertions", SHEET + " SELECT * FROM net_sheet")
sql(
    "nw_order",
    SHEET + " SELECT section, account, asserted_on, " + place("asserted_on DESC NULLS LAST, account") + " FROM net_sheet",
)
sql(
    "net_worth_trend",
    f""", m AS (SELECT CAST(m AS DATE) AS d FROM generate_series(timestamp '1995-01-01', timestamp '2001-08-01', INTERVAL 1 MONTH) g(m)),
    days AS (SELECT d FROM m), {rate_table('rates', "least(d + INTERVAL 1 MONTH - INTERVAL 1 DAY, date '2001-08-01')")},
    b AS (SELECT d, commodity, (SELECT sum(quantity) FROM now n WHERE n.commodity = c.commodity
              AND regexp_matches(account, '^(assets|liabilities)', 'i') AND n.date < d + INTERVAL 1 MONTH) AS amount
          FROM m, (SELECT DISTINCT commodity FROM post) c)
    SELECT b.d AS period, CASE WHEN rate IS NULL THEN b.commodity ELSE 'USD' END AS commodity,
           CAST(sum(CAST(amount AS DOUBLE) * coalesce(rate, 1.0)) AS {MONEY}) AS net_worth
    FROM b LEFT JOIN rates ON b.d = rates.d AND b.commodity = rates.commodity WHERE amount <> 0 GROUP BY ALL""",
)

# -- the register ------------------------------------------------------------

SPLIT = """, k AS (SELECT *, regexp_matches(account, '^(assets?|liabilit(y|ies))(:|$)', 'i') AS sheet FROM post),
split AS MATERIALIZED (SELECT tindex, leg, account, commodity, quantity,
    CASE WHEN count(*) FILTER (sheet) OVER t = 0 THEN true
         WHEN count(*) FILTER (sheet) OVER t > 1 AND count(*) FILTER (sheet AND quantity < 0) OVER t > 0
              THEN sheet AND quantity < 0
         ELSE sheet END AS shown FROM k WINDOW t AS (PARTITION BY tindex))"""
sql("split_legs", SPLIT + " SELECT * FROM split")
HAS = "txn.tindex IN (SELECT tindex FROM post WHERE {})"
HAY = """contains(lower(concat_ws(chr(10), payee, note, 'segment: ' || segment, 'priority: ' || priority)), '{0}')
    OR txn.tindex IN (SELECT tindex FROM post WHERE contains(lower(account), '{0}'))"""
sql("reg_search", heads(HAY.format("brand#11")))
sql("reg_search_tag", heads(HAY.format("segment: mach")))
sql("reg_date", heads("date BETWEEN date '1999-03-10' AND date '1999-03-20'"))
sql("reg_payee", heads("payee IN ('Internal Transfer', 'User 7', 'Customer#000000011')"))
sql("reg_account", heads(HAS.format("account IN ('Assets:Savings', 'Expenses:ECONOMY:Brand#3')")))
sql(
    "reg_amount",
    SPLIT + " " + heads("tindex IN (SELECT tindex FROM split WHERE shown AND abs(quantity) BETWEEN 100 AND 20000)"),
)
sql("reg_commodity", heads(HAS.format("commodity IN ('GBP', 'CHF')")))
sql("reg_status", heads("status IN ('Pending', 'Unmarked')"))
sql("reg_tag", heads("priority IS NOT NULL"))
sql(
    "reg_all_filters",
    SPLIT
    + " "
    + heads(
        f"""({HAY.format('economy')}) AND date BETWEEN date '1996-01-01' AND date '1999-12-31' AND status = 'Cleared'
        AND segment IS NOT NULL AND {HAS.format("commodity IN ('USD', 'EUR')")}
        AND tindex IN (SELECT tindex FROM split WHERE shown AND abs(quantity) >= 50000)"""
    ),
)
sql(
    "reg_preset",
    """SELECT preset, "first", "last", (SELECT count(*) FROM txn WHERE date BETWEEN "first" AND "last") AS n FROM (VALUES
    ('last-7-days', date '2001-07-26', date '2001-08-01'), ('last-30-days', date '2001-07-03', date '2001-08-01'),
    ('this-month', date '2001-08-01', date '2001-08-31'), ('last-month', date '2001-07-01', date '2001-07-31'),
    ('this-year', date '2001-01-01', date '2001-12-31'), ('last-year', date '2000-01-01', date '2000-12-31'))
    v(preset, "first", "last")""",
)
sql(
    "reg_hide_assertions",
    """SELECT tindex, date, payee FROM txn UNION ALL
    SELECT tindex, date, 'Balance Assertion' FROM asrt WHERE tindex % 100 = 0 AND quantity <> 0""",
)
sql(
    "reg_count",
    f"SELECT count(*) FILTER (status = 'Cleared' AND ({HAY.format('brand#2')})) AS shown, count(*) AS total FROM txn",
)
FACET = """SELECT '{facet}' AS facet, {value} AS value, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL"""
EURUAH = HAS.format("commodity IN ('EUR', 'UAH')")
PEND = "status = 'Pending'"
BOTH = f"{PEND} AND {EURUAH}"
sql(
    "facet_counts",
    "\nUNION ALL\n".join(
        [
            FACET.format(facet="payee", value="payee", source="txn", where=BOTH),
            FACET.format(facet="status", value="status", source="txn", where=EURUAH),
            f"SELECT 'tag', 'segment', count(*) FROM txn WHERE {BOTH} AND segment IS NOT NULL",
            f"SELECT 'tag', 'priority', count(*) FROM txn WHERE {BOTH} AND priority IS NOT NULL",
            FACET.format(
                facet="account", value="account", source="post",
                where=f"tindex IN (SELECT tindex FROM txn WHERE {BOTH})",
            ),
            FACET.format(
                facet="commodity", value="commodity", source="(SELECT DISTINCT tindex, commodity FROM post)",
                where=f"tindex IN (SELECT tindex FROM txn WHERE {PEND})",
            ),
        ]
    ),
)
sql(
    "facet_options",
    f"""SELECT facet, value, {place("facet, CASE value WHEN 'Cleared' THEN 1 WHEN 'Pending' THEN 2 WHEN 'Unmarked' THEN 3 ELSE 0 END, lower(value), value")}
    FROM (SELECT DISTINCT 'payee' AS facet, payee AS value FROM txn WHERE payee <> ''
    UNION ALL SELECT DISTINCT 'account', account FROM post UNION ALL SELECT DISTINCT 'commodity', commodity FROM post
    UNION ALL SELECT DISTINCT 'status', status FROM txn UNION ALL SELECT 'tag', 'segment' UNION ALL SELECT 'tag', 'priority')""",
)
sql("reg_order", heads("true", "tindex, date, payee, " + place("date DESC, lower(payee), tindex")))
sql("reg_order_rising", heads("true", "tindex, date, payee, " + place("date, lower(payee) DESC, tindex")))
sql(
    "reg_sorted",
    SPLIT
    + f""", lead AS (SELECT tindex, account, quantity FROM (SELECT *, row_number() OVER (PARTITION BY tindex
        ORDER BY leg, account, quantity) AS n FROM split WHERE shown) WHERE n = 1)
    SELECT txn.tindex, payee, account AS lead_account, CAST(quantity AS {MONEY}) AS lead_quantity,
           coalesce('segment: ' || segment || ' priority: ' || priority, '') AS tags_text,
           {place("quantity DESC, txn.tindex")}
    FROM txn JOIN lead ON txn.tindex = lead.tindex""",
)
sql(
    "reg_page",
    SPLIT
    + f""", lead AS (SELECT tindex, account FROM (SELECT *, row_number() OVER (PARTITION BY tindex
        ORDER BY leg, account, quantity) AS n FROM split WHERE shown) WHERE n = 1)
    SELECT * FROM (SELECT txn.tindex, payee, account AS lead_account, {place("lower(payee), txn.tindex")}
    FROM txn JOIN lead ON txn.tindex = lead.tindex) WHERE position BETWEEN 1001 AND 1500""",
)
sql(
    "nw_search",
    f"""SELECT account, commodity, CAST(CASE WHEN {KIND} = 'Liabilities' THEN -1 ELSE 1 END * sum(quantity) AS {MONEY}) AS amount,
    {KIND} AS section FROM post WHERE {KIND} IN ('Assets', 'Liabilities') AND contains(lower(account), 'bank:m')
    GROUP BY account, commodity HAVING sum(quantity) <> 0""",
)
NAMES = "SELECT name, " + place("lower(name), name") + " FROM ({})"
sql("list_accounts", NAMES.format("SELECT DISTINCT account AS name FROM post"))
sql("list_payees", NAMES.format("SELECT DISTINCT payee AS name FROM txn WHERE trim(payee) <> ''"))
sql("list_tags", NAMES.format("SELECT 'segment' AS name UNION ALL SELECT 'priority'"))

# -- scalar functions --------------------------------------------------------

sql("split_description", "SELECT tindex, payee, note FROM txn")
sql("tag_text", "SELECT tindex, coalesce('segment: ' || segment || ', priority: ' || priority, '') AS tags_text FROM txn")
sql(
    "depth_clip",
    f"""SELECT DISTINCT account, CAST(len(string_split(account, ':')) AS INTEGER) AS depth, {ONE} AS "one", {TWO} AS two FROM post""",
)
sql(
    "period",
    "SELECT DISTINCT date, "
    + ", ".join(
        f"CAST(date_trunc('{u}', date) AS DATE) AS {n}"
        for n, u in (("daily", "day"), ("weekly", "week"), ("monthly", "month"), ("quarterly", "quarter"), ("yearly", "year"))
    )
    + " FROM txn",
)
ORACLES["iso_date"] = """
WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN day[1:8] || '31' WHEN 2 THEN replace(day, '-0', '-')
             WHEN 3 THEN day[1:5] || '13-01' ELSE day END AS text FROM d)
SELECT o_orderkey, text, regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(text AS DATE) IS NOT NULL AS is_iso_date
FROM t"""

SIZES = """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS c,
                  l_suppkey % 4 AS kind, l_partkey % 9 AS p FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, l_partkey, p,
      CASE kind WHEN 0 THEN CAST((c + 50) // 100 AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(8,8))
           WHEN 1 THEN -c * CAST(0.01 AS DECIMAL(8,8)) WHEN 2 THEN CAST(c * 10 AS DECIMAL(28,8))
           ELSE c * CAST(0.01 AS DECIMAL(8,8)) END AS q FROM a)
"""


def grouped(most: str, least: str) -> str:
    """Grouped digits with ``most`` places, trailing zeros cut down to ``least``."""
    # Amounts carry at most six places here, so the cents are exact integers.
    cases = " ".join(
        f"WHEN {k} THEN format('{{:,}}', CAST(trunc(abs(r{k})) AS BIGINT))"
        + (f" || '.' || lpad(CAST(CAST((abs(r{k}) - trunc(abs(r{k}))) * {10**k} AS BIGINT) AS VARCHAR), {k}, '0')" if k else "")
        for k in range(9)
    )
    body = f"CASE {most} {cases} END"
    cut = f"""CASE WHEN {most} = 0 THEN {body} WHEN {least} = 1 THEN regexp_replace({body}, '(\\.[0-9][0-9]*?)0+$', '\\1')
        ELSE regexp_replace({body}, '(\\.[0-9]{{2}}[0-9]*?)0+$', '\\1') END"""
    return f"CASE WHEN q < 0 THEN '-' ELSE '' END || {cut}"


NATIVE_MOST = "CASE WHEN p = 0 THEN 0 ELSE least(greatest(p, 2), 8) END"
NATIVE_LEAST = "CASE WHEN p = 0 THEN 0 ELSE least(p, 2) END"
VALUE_MOST = "CASE WHEN p = 0 THEN 0 WHEN abs(q) < 1 AND p > 2 THEN least(p, 8) ELSE 2 END"
ROUNDED = ", ".join(f"CAST(round(q, {k}) AS DECIMAL(28,8)) AS r{k}" for k in range(9))
ORACLES["fmt_amount"] = (
    SIZES
    + f", c AS (SELECT *, {ROUNDED} FROM b) SELECT l_orderkey, l_linenumber, l_partkey, "
    + f"{grouped(NATIVE_MOST, NATIVE_LEAST)} || ' EUR' AS native, {grouped(VALUE_MOST, '2')} || ' EUR' AS value FROM c"
)


def compact(q: str = "q") -> str:
    """Compact notation: two significant digits below ten of a unit, else whole."""
    arms = []
    for unit, suffix in ((1, ""), (10**3, "K"), (10**6, "M"), (10**9, "B")):
        v = f"(abs({q}) / {unit}.0 + 1e-12)"  # halves are exact decimals: away from zero
        whole = f"CAST(CAST(round({v}) AS BIGINT) AS VARCHAR)"
        small = f"""CASE WHEN {v} >= 1 THEN printf('%.1f', round({v}, 1)) WHEN {v} >= 0.1 THEN printf('%.2f', round({v}, 2))
            WHEN {v} >= 0.01 THEN printf('%.3f', round({v}, 3)) WHEN {v} >= 0.001 THEN printf('%.4f', round({v}, 4))
            WHEN {v} >= 0.0001 THEN printf('%.5f', round({v}, 5)) ELSE printf('%.6f', round({v}, 6)) END"""
        text = f"CASE WHEN {v} >= 10 THEN {whole} ELSE rtrim(rtrim({small}, '0'), '.') END"
        limit = f"round({v}) < 1000" if unit < 10**9 else "true"
        arms.append(f"WHEN {limit} THEN {text} || '{suffix}'")
    return f"CASE WHEN {q} < 0 THEN '-' ELSE '' END || CASE {' '.join(arms)} END"


ORACLES["fmt_compact"] = SIZES + f"SELECT l_orderkey, l_linenumber, l_partkey, {compact()} AS compact FROM b"
GROUP2 = "format('{{:,.2f}}', {0})"
ORACLES["fmt_value"] = f"""
WITH o AS (SELECT o_orderkey, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS t,
                  {GROUP2.format('o_totalprice')} || ' EUR, 10.00 CHF' AS native,
                  {GROUP2.format('o_totalprice * 2')} || ' USD' AS usd FROM orders),
c AS (SELECT *, CAST(t * 2 AS DECIMAL(28,8)) AS q2, CAST(t AS DECIMAL(28,8)) AS q1 FROM o)
SELECT o_orderkey, s IN ('F', 'P') AS is_converted, native,
    CASE s WHEN 'F' THEN '~10.00 CHF, ' || usd WHEN 'P' THEN '~' || usd ELSE native END AS value,
    CASE s WHEN 'F' THEN '~' || usd WHEN 'P' THEN '~' || usd ELSE native END AS lead,
    CASE s WHEN 'F' THEN '10.00 CHF' ELSE '' END AS tail,
    CASE s WHEN 'F' THEN '~' || {compact('q2')} || ' USD +1' WHEN 'P' THEN '~' || {compact('q2')} || ' USD'
           ELSE {compact('q1')} || ' EUR +1' END AS compact
FROM c"""

FIG = f"""
WITH o AS (SELECT o_orderkey, o_orderstatus AS s, {GROUP2.format('o_totalprice')} || ' EUR' AS eur,
                  {GROUP2.format('o_totalprice * 2')} || ' USD' AS usd, o_orderkey % 3 AS b FROM orders)"""
ORACLES["fmt_amounts"] = FIG + """ SELECT o_orderkey, eur || ', 10.00 CHF' AS native,
    CASE s WHEN 'F' THEN '10.00 CHF, ' || usd WHEN 'P' THEN usd ELSE eur || ', 10.00 CHF' END AS value FROM o"""
ORACLES["is_converted"] = FIG + " SELECT s IN ('F', 'P') AS is_converted, count(*) AS n FROM o GROUP BY ALL"
ORACLES["value_lead"] = FIG + """ SELECT o_orderkey,
    CASE WHEN s = 'F' AND b = 0 THEN '~' || usd WHEN s = 'F' THEN '~10.00 CHF, ' || usd WHEN s = 'P' THEN '~' || usd
         WHEN b = 1 THEN eur ELSE eur || ', 10.00 CHF' END AS lead,
    CASE WHEN s = 'F' AND b = 0 THEN '10.00 CHF' WHEN s NOT IN ('F', 'P') AND b = 1 THEN '10.00 CHF' ELSE '' END AS tail FROM o"""

# -- validation --------------------------------------------------------------

sql(
    "unbalanced",
    f"""SELECT tindex, commodity, {total()} AS amount FROM post WHERE NOT (account LIKE 'Expenses%' AND quantity < 0)
    GROUP BY ALL HAVING sum(quantity) <> 0""",
)
CHART = """chart AS (SELECT unnest(['Assets:Savings', 'Assets:Cash', 'Income:Sales']) AS account
    UNION SELECT 'Expenses:' || p_type || ':' || p_brand FROM part
          WHERE CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) < 20
    UNION SELECT 'Assets:Bank:' || c_mktsegment FROM customer UNION SELECT 'Liabilities:Card:' || c_mktsegment FROM customer),
undecl AS (SELECT 'account' AS kind, account AS name, count(*) AS uses FROM post
      WHERE account NOT IN (SELECT account FROM chart) GROUP BY ALL
    UNION ALL SELECT 'commodity', commodity, count(*) FROM post WHERE commodity NOT IN ('USD', 'EUR', 'GBP', 'UAH') GROUP BY ALL)"""
sql("undeclared", f", {CHART} SELECT * FROM undecl")
sql(
    "validate",
    f"""{CHECKED}, {CHART}
    SELECT 'undeclared ' || kind AS rule, CAST(NULL AS BIGINT) AS tindex, name AS detail FROM undecl
    UNION ALL SELECT 'assertion', tindex, account || ' ' || balance || ' ' || commodity FROM checked
    WHERE late = 1 AND balance <> asserted""",
)
ORACLES["check_inputs"] = """
WITH e AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 50 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') END AS bad,
                  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)
SELECT item, 'date' AS rule, 'Transaction ' || item || ': date ' || bad || ' is not YYYY-MM-DD' AS message FROM e WHERE bad IS NOT NULL
UNION ALL SELECT item, 'postings', 'Transaction ' || item || ': fewer than 2 postings' FROM e WHERE n < 2
UNION ALL SELECT l_orderkey, 'amount', 'Transaction ' || l_orderkey || ': no amount for Expenses:' || l_partkey
    FROM lineitem WHERE NOT l_discount < 0.1
UNION ALL SELECT l_orderkey, 'currency', 'Transaction ' || l_orderkey || ': no currency for Expenses:' || l_partkey
    FROM lineitem WHERE NOT l_tax < 0.08"""
ORACLES["check_assertion_inputs"] = """
WITH e AS (SELECT event_id AS item, event_type, user_id, CASE event_type WHEN 'error' THEN '' ELSE 'Assets:' || event_type END AS a FROM events)
SELECT item, 'account' AS rule, 'Assertion ' || item || ': no account' AS message FROM e WHERE a = ''
UNION ALL SELECT item, 'amount', 'Assertion ' || item || ': no balance amount for ' || a FROM e WHERE event_type = 'view'
UNION ALL SELECT item, 'currency', 'Assertion ' || item || ': no balance currency for ' || a FROM e WHERE user_id % 7 = 0"""
ORACLES["check_price_inputs"] = """
WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS item, CASE l_linestatus WHEN 'O' THEN 'PART' || l_partkey ELSE '' END AS c,
                  l_extendedprice <= 50000 AS low, l_returnflag = 'R' AS r FROM lineitem)
SELECT item, 'commodity' AS rule, 'Price ' || item || ': no commodity' AS message FROM e WHERE c = ''
UNION ALL SELECT item, 'positive', 'Price ' || item || ': price not positive for ' || c FROM e WHERE low
UNION ALL SELECT item, 'target', 'Price ' || item || ': no target for ' || c FROM e WHERE r"""

# -- corrections -------------------------------------------------------------

MOVED = """, hit AS MATERIALIZED (SELECT tindex FROM txn WHERE payee LIKE 'Customer#%' AND year(date) = 1997
        AND tindex IN (SELECT tindex FROM post WHERE account LIKE '%Brand#5')
        AND tindex IN (SELECT tindex FROM post WHERE account = 'Expenses:ECONOMY:Brand#5')),
edited AS (SELECT * REPLACE (CASE WHEN account = 'Expenses:ECONOMY:Brand#5' AND tindex IN (SELECT tindex FROM hit)
        THEN 'Expenses:Moved' ELSE account END AS account) FROM post),
gone AS (SELECT * FROM post WHERE account = 'Expenses:ECONOMY:Brand#5' AND tindex IN (SELECT tindex FROM hit)),
renamed AS (SELECT tindex FROM txn WHERE payee = 'Internal Transfer' AND status = 'Pending'),
marked AS (SELECT tindex FROM txn WHERE year(date) = 1998 AND status <> 'Cleared'
        AND tindex IN (SELECT tindex FROM post WHERE account LIKE 'Liabilities%'))"""
sql("edit_targets", MOVED + " SELECT tindex FROM hit")
sql("edit_account", MOVED + " SELECT tindex, leg, account, commodity, quantity FROM edited")
sql(
    "edit_payee",
    MOVED
    + """ SELECT tindex, CASE WHEN tindex IN (SELECT tindex FROM renamed) THEN 'Own Transfer' ELSE payee END AS payee,
    status FROM txn""",
)
sql(
    "edit_status",
    MOVED
    + """ SELECT tindex, payee, CASE WHEN tindex IN (SELECT tindex FROM marked) THEN 'Cleared' ELSE status END AS status FROM txn""",
)
sql(
    "ledger_diff",
    MOVED
    + """ SELECT 'before' AS side, tindex, leg, account, commodity, quantity, count(*) AS copies FROM gone GROUP BY ALL
    UNION ALL SELECT 'after', tindex, leg, 'Expenses:Moved', commodity, quantity, count(*) FROM gone GROUP BY ALL""",
)
sql(
    "version_edits",
    MOVED
    + """ SELECT 'postings' AS frame, side, tindex, leg, CASE side WHEN 'before' THEN account ELSE 'Expenses:Moved' END AS value,
        count(*) AS copies FROM gone, (VALUES ('before'), ('after')) s(side) GROUP BY ALL
    UNION ALL SELECT 'transactions', side, tindex, NULL, CASE side WHEN 'before' THEN 'Internal Transfer' ELSE 'Own Transfer' END,
        count(*) FROM renamed, (VALUES ('before'), ('after')) s(side) GROUP BY ALL""",
)
sql(
    "edit_summary",
    MOVED
    + """, n AS (SELECT count(DISTINCT tindex) AS t, count(*) AS p FROM gone)
    SELECT t AS transactions, p AS postings, p || ' posting(s) across ' || t || ' transaction(s) -> Expenses:Moved' AS summary FROM n
    UNION ALL SELECT count(*), 0, count(*) || ' payee(s) renamed to "Own Transfer"' FROM renamed
    UNION ALL SELECT count(*), 0, count(*) || ' transaction(s) marked cleared' FROM marked""",
)
sql(
    "edit_dry_run",
    CHECKED
    + MOVED
    + f""", {CHART} SELECT 'change before' AS what, count(*) AS n FROM gone UNION ALL SELECT 'change after', count(*) FROM gone
    UNION ALL SELECT 'undeclared commodity', count(*) FROM undecl WHERE kind = 'commodity' HAVING count(*) > 0
    UNION ALL SELECT 'undeclared account', count(DISTINCT account) FROM edited WHERE account NOT IN (SELECT account FROM chart)
    UNION ALL SELECT 'assertion', count(*) FROM checked WHERE late = 1 AND balance <> asserted HAVING count(*) > 0""",
)

# -- composed analyses -------------------------------------------------------

EXPENSE = "account LIKE 'Expenses:%'"
sql(
    "top_payees",
    f"""SELECT payee, commodity, {total()} AS amount, count(DISTINCT tindex) AS transactions FROM {LINES} WHERE {EXPENSE}
    GROUP BY ALL ORDER BY amount DESC, payee, commodity LIMIT 25""",
)
sql(
    "biggest_purchase",
    f""", s AS (SELECT tindex, date, commodity, {total()} AS amount FROM post WHERE {EXPENSE} AND year(date) = 1997 GROUP BY ALL)
    SELECT commodity, s.tindex, s.date, amount, payee FROM (
        SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY amount DESC, tindex) AS n FROM s) s
    JOIN txn ON txn.tindex = s.tindex WHERE n = 1""",
)
sql(
    "compare_months",
    f""", s AS (SELECT {TWO} AS account, commodity, CAST(date_trunc('month', date) AS DATE) AS period, {total()} AS amount
               FROM now WHERE {EXPENSE} GROUP BY ALL),
    d AS (SELECT a.account, a.commodity, CAST(m AS DATE) AS period FROM (SELECT DISTINCT account, commodity FROM s) a,
          generate_series(timestamp '1995-01-01', timestamp '2001-08-01', INTERVAL 1 MONTH) g(m)),
    f AS (SELECT account, commodity, period, coalesce(amount, 0) AS amount FROM d LEFT JOIN s USING (account, commodity, period)),
    w AS (SELECT *, coalesce(lag(amount) OVER (PARTITION BY account, commodity ORDER BY period), 0) AS previous FROM f)
    SELECT account, commodity, period, amount, CAST(previous AS {MONEY}) AS previous, CAST(amount - previous AS {MONEY}) AS change FROM w""",
)
sql(
    "spending_by_month",
    f"""SELECT CAST(date_trunc('month', date) AS DATE) AS period, commodity, {total()} AS amount FROM post
    WHERE {EXPENSE} GROUP BY ALL""",
)
sql(
    "savings",
    f"""SELECT CAST(date_trunc('month', date) AS DATE) AS period, commodity,
    CAST(coalesce(sum(-quantity) FILTER (account LIKE 'Income:%'), 0) AS {MONEY}) AS earned,
    CAST(coalesce(sum(quantity) FILTER ({EXPENSE}), 0) AS {MONEY}) AS spent, CAST(sum(-quantity) AS {MONEY}) AS saved
    FROM post WHERE account LIKE 'Income:%' OR {EXPENSE} GROUP BY ALL""",
)
sql("by_currency", f"SELECT commodity, {total()} AS amount FROM post WHERE account LIKE 'Assets:%' GROUP BY ALL HAVING sum(quantity) <> 0")
sql("tag_cost", balances(f"{EXPENSE} AND priority LIKE '%URGENT%'", source=LINES))
sql(
    "duplicates",
    f""", c AS (SELECT DISTINCT post.tindex, post.date, payee, account, commodity, CAST(round(quantity / 10) AS {MONEY}) AS quantity
        FROM post JOIN txn ON post.tindex = txn.tindex)
    SELECT date, payee, account, commodity, quantity, count(*) AS transactions, min(tindex) AS first_tindex,
           max(tindex) AS last_tindex FROM c GROUP BY ALL HAVING count(*) > 1""",
)
sql(
    "recurring",
    f""", d AS (SELECT payee, account, commodity, date, {total()} AS amount FROM {LINES} WHERE {EXPENSE} GROUP BY ALL),
    w AS (SELECT *, date - lag(date) OVER p AS gap, lag(amount) OVER p AS previous FROM d
          WINDOW p AS (PARTITION BY payee, account, commodity ORDER BY date))
    SELECT payee, account, commodity, count(*) AS payments, quantile_cont(gap, 0.5) AS median_gap,
           CAST(arg_max(amount, date) AS {MONEY}) AS last_amount,
           CAST(arg_max(amount - previous, date) AS {MONEY}) AS change
    FROM w GROUP BY ALL HAVING count(*) >= 2""",
)
sql(
    "budget",
    f""", b AS (SELECT 'Expenses:' || p_type AS account, 'USD' AS commodity,
        CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(28,6)) AS s FROM part GROUP BY ALL),
    plan AS (SELECT account, commodity, CAST(round(s / 100 + 1e-9, 2) AS {MONEY}) AS budget FROM b),
    r AS (SELECT {TWO} AS account, commodity, CAST(date_trunc('month', date) AS DATE) AS period, {total()} AS spent
          FROM post WHERE {EXPENSE} GROUP BY ALL),
    m AS (SELECT CAST(unnest(generate_series(CAST(min(period) AS TIMESTAMP), CAST(max(period) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)
          AS period FROM r)
    SELECT account, commodity, period, budget, CAST(coalesce(spent, 0) AS {MONEY}) AS spent,
           CAST(budget - coalesce(spent, 0) AS {MONEY}) AS "left"
    FROM plan CROSS JOIN m LEFT JOIN r USING (account, commodity, period)""",
)
sql("uncategorized", balances("regexp_matches(account, 'expenses:standard', 'i')"))

# -- sessions, events, documents ---------------------------------------------

FIRST = """WITH s AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS first_message,
    count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id)"""
ORACLES["session_summary"] = FIRST + " SELECT * FROM s"
ORACLES["session_title"] = (
    FIRST
    + r""", t AS (SELECT conv_id, trim(regexp_replace(first_message, '\s+', ' ', 'g')) AS title FROM s)
SELECT conv_id, CASE WHEN title = '' THEN NULL WHEN length(title) > 60 THEN rtrim(title[1:60]) || '…' ELSE title END AS title FROM t"""
)
ORACLES["session_groups"] = """
WITH s AS (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id)
SELECT user_id, strftime(m, '%Y-%m-%d %H:%M:%S') AS modified, CASE WHEN m >= timestamp '2024-01-30' THEN 'Today'
    WHEN m >= timestamp '2024-01-29' THEN 'Yesterday' ELSE 'Earlier' END AS label,
    row_number() OVER (ORDER BY m DESC, user_id) AS position FROM s"""
MESSAGES = "WITH m AS (SELECT conv_id, turn, text, conv_id * 100 + turn AS n FROM conversations)"
ORACLES["mentions"] = (
    MESSAGES
    + """ SELECT conv_id, turn, 0 AS n, 'account' AS type, 'acc' || n AS label FROM m WHERE n % 3 = 0
UNION ALL SELECT conv_id, turn, 1, 'tag', 'trip' FROM m WHERE n % 3 = 0
UNION ALL SELECT conv_id, turn, 0, 'payee', 'Shop ' || n FROM m WHERE n % 3 = 2"""
)
ORACLES["attachment_refs"] = (
    MESSAGES
    + """ SELECT conv_id, turn, 0 AS n, 'f' || n || '.pdf' AS name, 'files/f' || n || '.pdf' AS path, n * 7 AS size
FROM m WHERE n % 3 < 2"""
)
ORACLES["mentions_plain"] = (
    MESSAGES
    + r""", t AS (SELECT conv_id, turn, n, text || chr(10) AS head,
    '[[attachment]]{"name": "f' || n || '.pdf", "path": "files/f' || n || '.pdf", "size": ' || (n * 7) || '}' AS marker FROM m),
u AS (SELECT conv_id, turn, n, head || CASE n % 3 WHEN 0 THEN 'see :account[acc' || n || ']{name=x} and :tag[trip]' WHEN 1 THEN ''
           ELSE 'pay :payee[Shop ' || n || '] at 10:30 :foo[x]' END AS said,
       head || CASE n % 3 WHEN 0 THEN 'see acc' || n || ' and trip' WHEN 1 THEN '' ELSE 'pay Shop ' || n || ' at 10:30 :foo[x]' END AS plain,
       CASE n % 3 WHEN 0 THEN chr(10) || marker WHEN 1 THEN marker || chr(10) || '[[attachment]]{broken' ELSE '' END AS tail FROM t),
v AS (SELECT *, trim(regexp_replace(plain, '\s+', ' ', 'g')) AS line FROM u)
SELECT conv_id, turn, md5(plain || tail) AS plain, md5(regexp_replace(said, '^\s+|\s+$', '', 'g')) AS visible,
    CASE WHEN line = '' THEN 'f' || n || '.pdf' WHEN length(line) > 60 THEN rtrim(line[1:60]) || '…' ELSE line END AS title
FROM v"""
)
ORACLES["first_events"] = """SELECT user_id, event_type, event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1"""
OUT = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
o AS (SELECT user_id FROM f WHERE n = 1 AND event_type = 'error')"""
ORACLES["gated_events"] = OUT + " SELECT event_id, user_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM o)"
ORACLES["milestones"] = OUT + " SELECT user_id, event_type, event_id FROM f WHERE k = 1 AND user_id NOT IN (SELECT user_id FROM o)"
ORACLES["page_profile"] = r"""
WITH d AS (SELECT doc_id, [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(text, chr(10))] AS p FROM documents),
k AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS p FROM d),
n AS (SELECT doc_id, p, greatest(len(p), 1) AS pages, coalesce(list_sum([length(x) FOR x IN p]), 0) AS chars FROM k)
SELECT doc_id, CAST(pages AS INTEGER) AS pages, round(chars / pages, 6) AS chars_per_page, chars / pages < 50 AS needs_ocr,
    CASE WHEN chars / pages >= 50 THEN md5(array_to_string([
        '--- Page ' || i || ' ---' || chr(10) || p[i] FOR i IN range(1, len(p) + 1)], chr(10) || chr(10))) END AS page_text
FROM n"""

# -- readers and writers -----------------------------------------------------

PARSED = """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS date, 'Customer ' || o_custkey AS payee,
    o_orderpriority AS note, CASE o_orderstatus WHEN 'F' THEN 'Cleared' ELSE 'Unmarked' END AS status,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(28,2)) AS total,
    CAST(CASE WHEN o_orderkey % 3 <> 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS p
    FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)"""
ORACLES["read_transactions_json"] = (
    PARSED
    + """, l AS (
    SELECT k, 1 AS leg, CAST(NULL AS DATE) AS pdate, 'Expenses:Orders' AS account, 'USD' AS commodity, total AS quantity, p AS precision, false AS is_assertion FROM o
    UNION ALL SELECT k, 2, date '2001-01-01', 'Assets:Bank', 'USD', -total, p, true FROM o
    UNION ALL SELECT k, 5, NULL, 'Bad:Amount', NULL, NULL, NULL, false FROM o
    UNION ALL SELECT k, 6, NULL, 'Lots}]', 'USD', 10 - total, p, false FROM o)
SELECT o.k AS tindex, date, payee, note, status, 'priority: ' || note || ', bare' AS tags_text, leg, pdate, account, commodity,
    quantity, precision, is_assertion FROM o JOIN l ON o.k = l.k"""
)
ORACLES["read_transactions_array"] = ORACLES["read_transactions_json"]
ORACLES["read_assertions_json"] = (
    PARSED
    + """ SELECT k AS tindex, 2 AS leg, date '2001-01-01' AS date, 'Assets:Bank' AS account, total AS quantity,
'USD' AS commodity, p AS precision FROM o"""
)
ORACLES["read_balance_sheet_json"] = """
WITH c AS (SELECT c_custkey, 'Assets:' || c_mktsegment AS account,
                  CAST(CAST(c_acctbal AS DECIMAL(18,2)) - 0.5 AS DECIMAL(28,2)) AS q FROM customer WHERE c_custkey % 17 <> 0),
s AS (SELECT c_custkey, account, CASE WHEN q = 0 THEN 'EUR' ELSE 'EUR' END AS commodity, q FROM c)
SELECT c_custkey, 'account' AS kind, 'Assets' AS section, account, commodity, q AS quantity FROM s
UNION ALL SELECT c_custkey, 'account', 'Assets', 'Assets:Empty', NULL, NULL FROM s
UNION ALL SELECT c_custkey, 'total', 'Assets', '', commodity, q FROM s
UNION ALL SELECT c_custkey, 'total', 'Liabilities', '', NULL, NULL FROM s
UNION ALL SELECT c_custkey, 'net', 'Net', '', commodity, q FROM s"""
ORACLES["read_prices"] = (
    "WITH "
    + INFERRED
    + """ SELECT seq, date, commodity, price, CASE seq % 4 WHEN 2 THEN '$' WHEN 3 THEN 'UAH' ELSE 'USD' END AS target
FROM inf WHERE seq % 10 <> 0"""
)
FIXED = "CASE WHEN quantity < 0 THEN '-' ELSE '' END || CAST(abs(quantity) AS VARCHAR) || ' ' || commodity"
sql(
    "render_journal",
    f""", pad AS (SELECT *, '    ' || account AS prefix, {FIXED} AS amount FROM post)
    SELECT tindex, 0 AS part, 0 AS side, strftime(date, '%Y-%m-%d') || ' '
           || CASE status WHEN 'Cleared' THEN '* ' WHEN 'Pending' THEN '! ' ELSE '' END || payee
           || CASE WHEN note = '' THEN '' ELSE ' | ' || note END AS line FROM txn
    UNION ALL SELECT tindex, 1, 0, '    ; segment: ' || segment FROM txn WHERE segment IS NOT NULL
    UNION ALL SELECT tindex, 1, 0, '    ; priority: ' || priority FROM txn WHERE priority IS NOT NULL
    UNION ALL SELECT tindex, 2, CASE WHEN quantity < 0 THEN 0 ELSE 1 END, prefix
        || repeat(' ', CAST(greatest(2, 69 - CASE WHEN quantity < 0 THEN 1 ELSE 0 END - length(prefix)) AS INTEGER)) || amount FROM pad""",
)
sql(
    "read_journal",
    f"""SELECT t.date, payee, note, status, coalesce('priority: ' || priority || ', segment: ' || segment, '') AS tags_text,
    account, commodity, count(*) AS legs, {total()} AS quantity FROM post p JOIN txn t ON p.tindex = t.tindex
    GROUP BY t.tindex, t.date, payee, note, status, segment, priority, account, commodity""",
)
APPENDED = f""", h AS (SELECT *, CAST(tindex % 2 + 1 AS INTEGER) AS batch FROM txn {{where}}),
    n AS (SELECT *, row_number() OVER (ORDER BY year(date), month(date), batch, date, tindex) AS position FROM h)
    SELECT position, n.date, payee, note, status, coalesce('priority: ' || priority || ', segment: ' || segment, '') AS tags_text,
    batch, account, commodity, count(*) AS legs, {total()} AS quantity FROM post p JOIN n ON p.tindex = n.tindex
    GROUP BY position, n.date, payee, note, status, segment, priority, batch, account, commodity"""
sql("journal_append", APPENDED.format(where=""))
sql("journal_months", APPENDED.format(where="WHERE date >= date '1996-02-01' AND date < date '1996-05-01'"))
sql(
    "render_assertions",
    """SELECT date, tindex, strftime(date, '%Y-%m-%d') || ' * Balance Assertion' || chr(10) || '    ' || account
    || repeat(' ', CAST(greatest(2, 65 - length(account)) AS INTEGER)) || '0.00 USD = ' || quantity || ' USD' AS entry FROM asrt""",
)
ORACLES["render_prices"] = (
    "WITH "
    + INFERRED
    + """ SELECT date, seq, 'P ' || strftime(date, '%Y-%m-%d') || ' "' || commodity || '" '
|| rtrim(rtrim(CAST(price AS VARCHAR), '0'), '.') || ' USD' AS line FROM inf"""
)
sql("missing_declarations", "SELECT DISTINCT 'commodity CHF' AS line FROM post WHERE commodity = 'CHF'")
sql(
    "read_declarations",
    """SELECT DISTINCT account, 'kept since ' || length(account) AS comment FROM post
    UNION ALL SELECT DISTINCT commodity, 'commodity' FROM post""",
)
sql(
    "month_layout",
    """SELECT tindex, date, account, commodity, quantity FROM post WHERE date >= date '1996-02-10' AND date < date '1996-04-05'""",
)
ORACLES["file_catalog"] = """
WITH p AS (SELECT lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') AS month, page_id % 8 AS k,
    'page-' || page_id || ['.pdf', '.csv', '.PNG', '.xlsx', '.jpeg', '', '.', '.tar.gz'][page_id % 8 + 1] AS name,
    length(html) * (page_id % 5 + 1) * CASE WHEN page_id % 3 = 0 THEN 977 ELSE 1 END AS n FROM pages),
e AS (SELECT *, ['pdf', 'csv', 'png', 'xlsx', 'jpeg', '', '', 'gz'][k + 1] AS extension,
    CASE WHEN n < 1000 THEN 0 WHEN n < 1000000 THEN 1 WHEN n < 1000000000 THEN 2 ELSE 3 END AS u FROM p),
s AS (SELECT *, n / power(1000, u) AS v FROM e)
SELECT '/files/2024/' || month || '/' || name AS path, name, '2024' AS year, month, extension, upper(extension) AS label,
    CASE WHEN extension IN ('csv', 'xlsx') THEN 'spreadsheet' WHEN extension IN ('png', 'jpeg') THEN 'image' ELSE 'document' END AS kind,
    CASE WHEN u = 0 THEN CAST(n AS VARCHAR) WHEN v >= 9.95 THEN CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR)
         ELSE regexp_replace(printf('%.1f', v), '\\.0$', '') END || ' ' || ['B', 'KB', 'MB', 'GB'][u + 1] AS size
FROM s"""
ORACLES["export_csv"] = """
SELECT c_custkey || ',' || CASE WHEN c_custkey % 3 = 0 THEN chr(34) || c_name || ', ' || repeat(chr(34), 2) || 'Ltd' || repeat(chr(34), 3) ELSE c_name END || ','
    || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS line FROM customer"""
sql(
    "output_formats",
    f""", b AS ({balances(account=TWO)})
    SELECT 'txt' AS format, account || '  ' || commodity || '  ' || amount AS line FROM b
    UNION ALL SELECT 'csv', account || ',' || commodity || ',' || amount FROM b
    UNION ALL SELECT 'tsv', account || chr(9) || commodity || chr(9) || amount FROM b
    UNION ALL SELECT 'json', '{{"account":"' || account || '","commodity":"' || commodity || '","amount":' || amount || '}}' FROM b""",
)
sql(
    "preview",
    f""", b AS ({balances()}), l AS (SELECT account || ',' || commodity || ',' || amount AS line, account, commodity FROM b)
    SELECT line FROM l""",
)
