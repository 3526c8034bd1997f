"""Books kept in order and event tables.

Orders become transactions with one expense leg per line and one paying leg;
purchase events become income transactions.  No frame here is numbered, sorted or
collected: legs keep the line number they were stored with, so a transaction may
hold any share of all rows without one task having to see all of it.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tallyframe.model import ASSERTIONS, LAST_LEG, POSTINGS, PRICES, QUANTITY, TRANSACTIONS, Ledger, conform
from tallyframe.operators.totals import spread

INCOME_BASE = 2_000_000_000
ASSERTION_BASE = 3_000_000_000
PRICE_MONTHS = 360  # 1995-01 to 2024-12

# Given schemas, so that no job has to read file footers to plan a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}.parquet")


def _bounds(stamp: str, begin: dt.date | None, end: dt.date | None) -> str:
    """Date bounds on the raw timestamp, a form the parquet scan can use."""
    terms = ["true"]
    if begin is not None:
        terms.append(f"{stamp} >= timestamp_ntz'{begin.isoformat()}'")
    if end is not None:
        terms.append(f"{stamp} < timestamp_ntz'{end.isoformat()}'")
    return " AND ".join(terms)


# A refunded line counts negative.
LINE_AMOUNT = "CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) " \
    "ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END"


class OrderBooks:
    """Maps one folder of tables onto the canonical frames.

    ``begin`` and ``end`` (half-open) prune at the scan.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        begin: dt.date | None = None,
        end: dt.date | None = None,
    ):
        self.spark, self.path, self.begin, self.end = spark, path, begin, end
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = table(self.spark, self.path, name)
        return self._tables[name]

    @cached_property
    def _orders(self) -> DataFrame:
        """One row per order, with its customer.  Nations are 25 rows at any scale; how
        the other joins run is left to their measured sizes."""
        return self.spark.sql(
            f"""
            SELECT o_orderkey,
                   o_orderkey + 1 AS tindex,
                   CAST(o_orderdate AS DATE) AS date,
                   c_name AS customer,
                   o_orderpriority AS priority,
                   c_mktsegment AS segment,
                   CASE o_orderstatus WHEN 'F' THEN 'Cleared' WHEN 'P' THEN 'Pending' ELSE 'Unmarked' END AS status,
                   CAST(o_totalprice AS DECIMAL(18,2)) AS total,
                   CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP'
                                    WHEN 3 THEN 'UAH' ELSE 'CHF' END AS commodity
            FROM {{orders}}
            JOIN {{customer}} ON o_custkey = c_custkey
            JOIN {{nation}} ON c_nationkey = n_nationkey
            WHERE {_bounds('o_orderdate', self.begin, self.end)}
            """,
            orders=self.table("orders"),
            customer=self.table("customer"),
            nation=self.table("nation"),
        )

    @cached_property
    def _headers(self) -> DataFrame:
        """Orders with the sum of their lines, NULL where there is none.  The sum is
        combined before its shuffle, so a huge order arrives as a handful of rows."""
        return self.spark.sql(
            f"""
            SELECT o.*, s.line_total
            FROM {{orders}} o
            LEFT JOIN (
                SELECT l_orderkey, CAST(sum({LINE_AMOUNT}) AS {QUANTITY}) AS line_total
                FROM {{lineitem}} GROUP BY l_orderkey
            ) s ON o_orderkey = l_orderkey
            """,
            orders=spread(self._orders, "o_orderkey", beside=(self.table("lineitem"),)),
            lineitem=self.table("lineitem"),
        )

    @cached_property
    def _purchases(self) -> DataFrame:
        return (
            self.table("events")
            .where(f"event_type = 'purchase' AND {_bounds('ts', self.begin, self.end)}")
            .selectExpr(
                f"event_id + {INCOME_BASE} AS tindex",
                "CAST(ts AS DATE) AS date",
                "user_id",
                "CAST(value AS DECIMAL(18,2)) AS value",
            )
        )

    def transactions(self) -> DataFrame:
        orders = self._headers.selectExpr(
            "tindex",
            "date",
            "CASE WHEN line_total IS NULL THEN 'Internal Transfer' ELSE customer END AS payee",
            "priority AS note",
            "status",
            "array(named_struct('name', 'segment', 'value', segment), "
            "named_struct('name', 'priority', 'value', priority)) AS tags",
        )
        income = self._purchases.selectExpr(
            "tindex",
            "date",
            "concat('User ', user_id) AS payee",
            "'' AS note",
            "'Cleared' AS status",
            "CAST(array() AS array<struct<name:string,value:string>>) AS tags",
        )
        return conform(orders.union(income), TRANSACTIONS)

    def postings(self) -> DataFrame:
        expenses = self.spark.sql(
            f"""
            SELECT tindex, l_linenumber AS leg, date, concat_ws(':', 'Expenses', p_type, p_brand) AS account,
                   commodity, CAST({LINE_AMOUNT} AS {QUANTITY}) AS quantity
            FROM {{lineitem}}
            JOIN {{orders}} ON l_orderkey = o_orderkey
            JOIN {{part}} ON l_partkey = p_partkey
            """,
            lineitem=self.table("lineitem"),
            orders=self._orders,
            part=self.table("part"),
        )
        paying = self._headers.selectExpr(
            "tindex",
            "date",
            "commodity",
            f"""inline(filter(array(
                CASE WHEN line_total IS NULL THEN
                    named_struct('leg', 1, 'account', 'Assets:Savings', 'quantity', CAST(total AS {QUANTITY})) END,
                named_struct('leg', {LAST_LEG},
                    'account', concat(CASE status WHEN 'Pending' THEN 'Liabilities:Card:' ELSE 'Assets:Bank:' END, segment),
                    'quantity', CAST(-coalesce(line_total, total) AS {QUANTITY}))
            ), l -> l IS NOT NULL))""",
        ).select("tindex", "leg", "date", "account", "commodity", "quantity")
        income = self._purchases.selectExpr(
            "tindex",
            "date",
            "'USD' AS commodity",
            f"""inline(array(
                named_struct('leg', 1, 'account', 'Assets:Cash', 'quantity', CAST(value AS {QUANTITY})),
                named_struct('leg', 2, 'account', 'Income:Sales', 'quantity', CAST(-value AS {QUANTITY}))))""",
        ).select("tindex", "leg", "date", "account", "commodity", "quantity")
        legs = expenses.union(paying).union(income)
        return conform(legs.selectExpr("*", "0 AS pos", "2 AS precision", "false AS is_assertion"), POSTINGS)

    def prices(self) -> DataFrame:
        """Declared prices, one row per pair and month start.  ``k`` counts months from
        year 0, so that a price does not depend on the first month."""
        return conform(
            self.spark.sql(
                f"""
                SELECT date, q.commodity, q.price, q.target, 'declared' AS source, id * 3 + q.n AS seq
                FROM (
                    SELECT id, add_months(date'1995-01-01', CAST(id AS INT)) AS date, id + 12 * 1995 AS k
                    FROM range({PRICE_MONTHS})
                ) LATERAL VIEW explode(array(
                    named_struct('commodity', 'GBP', 'price', 1.10 + CAST(k % 10 AS DECIMAL(4,0)) * 0.01,
                                 'target', 'EUR', 'n', 1),
                    named_struct('commodity', 'USD', 'price', CASE WHEN k % 2 = 0 THEN 40 ELSE 25 END + 0.00,
                                 'target', 'UAH', 'n', 2),
                    named_struct('commodity', 'EUR', 'price', 1.05 + CAST(k % 20 AS DECIMAL(4,0)) * 0.01,
                                 'target', 'USD', 'n', 3)
                )) AS q
                """
            ),
            PRICES,
        )

    def inferred_prices(self) -> DataFrame:
        """What each part cost per unit where it was bought: one price per line."""
        return conform(
            self.table("lineitem")
            .where("l_quantity > 0")
            .selectExpr(
                "CAST(l_shipdate AS DATE) AS date",
                "concat('PART', l_partkey) AS commodity",
                "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) / CAST(l_quantity AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS price",
                "'USD' AS target",
                "'inferred' AS source",
                "l_orderkey * 8 + l_linenumber AS seq",
            ),
            PRICES,
        )

    def assertions(self) -> DataFrame:
        """Signup events assert the cash account; error events assert wallets nobody
        posts to, a third of them rightly at zero."""
        return conform(
            self.table("events")
            .where("event_type IN ('signup', 'error')")
            .selectExpr(
                f"event_id + {ASSERTION_BASE} AS tindex",
                "1 AS leg",
                "CAST(ts AS DATE) AS date",
                "CASE event_type WHEN 'signup' THEN 'Assets:Cash' ELSE concat('Assets:Wallet:', user_id % 10) END AS account",
                "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END AS quantity",
                "'USD' AS commodity",
                "2 AS precision",
            ),
            ASSERTIONS,
        )

    def accounts(self) -> DataFrame:
        """A chart without the brands 20 and up, so that some accounts are undeclared."""
        return self.spark.sql(
            r"""
            SELECT explode(array('Assets:Savings', 'Assets:Cash', 'Income:Sales')) AS account
            UNION ALL
            SELECT DISTINCT concat_ws(':', 'Expenses', p_type, p_brand) FROM {part}
            WHERE CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) < 20
            UNION ALL
            SELECT DISTINCT concat(kind, c_mktsegment) FROM {customer}
            LATERAL VIEW explode(array('Assets:Bank:', 'Liabilities:Card:')) AS kind
            """,
            part=self.table("part"),
            customer=self.table("customer"),
        )

    def commodities(self) -> DataFrame:
        """Declared commodities: all but CHF."""
        return self.spark.sql("SELECT explode(array('USD', 'EUR', 'GBP', 'UAH')) AS commodity")

    def ledger(self) -> Ledger:
        return Ledger(
            self.transactions,
            self.postings,
            self.prices,
            self.assertions,
            self.accounts,
            self.commodities,
        )
