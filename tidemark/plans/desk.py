"""Queries of the trading desk, lists and reports, catalogs and checks, each with SQL that says the same where SQL can."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import alerts, backtest, cleaning, consensus, desk, features, knowledge, learn, manifest, portfolio, retrieval, signals, splits, vector_index
from tidemark.operators import text as docs
from tidemark.plans.queries import _CROSS, _LISTS, _MACD, _SCORES, _VOTES, _WEIGHTS, BARS, ORACLE_SQL, W, _scratch, query, r6, scored_signals, sql_roll, table, votes_of
from tidemark.sources import bars as B
from tidemark.sources import files as files_
from tidemark.sources import tolerant

#: The MACD in SQL after the crossing means, its tables named otherwise.
_MACD_2 = re.sub(r"\b([fms])( AS \(SELECT \*|\)(?=[,\s]|$))", r"\g<1>2\g<2>", _MACD.removeprefix(_LISTS)) + f", u2 AS (SELECT symbol, unnest(t) AS ts, unnest(macd) - unnest(sig) AS h FROM s2), p2 AS (SELECT *, lag(h) OVER {W}) AS h1 FROM u2)"
_MACD_SIGNAL = "CASE WHEN h1 <= 0 AND h > 0 THEN 'BUY' WHEN h1 >= 0 AND h < 0 THEN 'SELL' ELSE 'HOLD' END"

# scans and lists


def _scores(spark, d):
    return consensus.consensus(consensus.usable(votes_of(spark, d))).select(F.col("decision_id").cast("string").alias("symbol"), "consensus")


@query(f"WITH {_SCORES} SELECT count(*) AS symbols, count(CASE WHEN c > 0.3 THEN 1 END) AS buys, count(CASE WHEN c < -0.3 THEN 1 END) AS sells, count(CASE WHEN c BETWEEN -0.3 AND 0.3 THEN 1 END) AS neutral FROM s")
def desk_scan_summary(spark, d):
    return desk.scan_summary(_scores(spark, d))


@query(f"WITH {_SCORES}, r AS (SELECT CAST(decision_id AS VARCHAR) AS symbol, c, row_number() OVER (ORDER BY round(abs(c), 9) DESC, CAST(decision_id AS VARCHAR)) AS rank FROM s) SELECT symbol, round(c, 6) AS consensus, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 25")
def desk_strongest(spark, d):
    return r6(desk.strongest(_scores(spark, d).withColumn("consensus", F.round("consensus", 9)), 25))


@query("""WITH r AS (SELECT event_id, event_type AS symbol, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events) SELECT event_id, symbol, CAST(ts AS VARCHAR) AS ts, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def desk_newest(spark, d):
    """The 20 newest events of each type."""
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return r6(desk.newest(rows, 20, "event_id", ["symbol"]))


@query("""WITH l AS (SELECT o_orderkey AS decision_id, o_orderpriority AS symbol, CASE o_orderstatus WHEN 'F' THEN 'BUY' WHEN 'O' THEN 'SELL' ELSE 'HOLD' END AS action, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders),
    r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, decision_id) AS rank FROM l WHERE action IN ('BUY', 'SELL') AND symbol IN ('1-URGENT', '2-HIGH')) SELECT decision_id, symbol, action, CAST(ts AS VARCHAR) AS ts, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50""")  # fmt: skip
def desk_decision_log(spark, d):
    """The 50 newest buys and sells of two symbols."""
    status = F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderpriority").alias("symbol"), F.when(status == "F", "BUY").when(status == "O", "SELL").otherwise("HOLD").alias("action"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return r6(desk.decision_log(rows, ["BUY", "SELL"], ["1-URGENT", "2-HIGH"]))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY label, i),
    p AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY label), s AS (SELECT vec_id, p.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS sim FROM embeddings, p),
    r AS (SELECT *, row_number() OVER w AS k, round(sim - lead(sim) OVER w, 9) AS margin FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY sim DESC, label)), q AS (SELECT *, row_number() OVER (ORDER BY margin, vec_id) AS rank FROM r WHERE k = 1 AND margin >= 0.05 AND margin < 0.10)
    SELECT vec_id, label, round(margin, 6) AS margin, CAST(rank AS INTEGER) AS rank FROM q WHERE rank <= 100""")  # fmt: skip
def desk_review_queue(spark, d):
    """The 100 least clear zero-shot labels that need review."""
    vectors = table(spark, d, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    prompts = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("label", F.transform("v", lambda p: p["x"]).alias("embedding"))
    labelled = retrieval.zero_shot(vectors, prompts).withColumn("margin", F.round("margin", 9))
    return r6(desk.review_queue(labelled, 100).select("vec_id", "label", "margin", "rank"))


_CENTS = _SCORES.replace("least(value / 100, 1.0)", "least(floor(value) / 100, 1.0)")


@query(f"""WITH {_CENTS}, v AS (SELECT decision_id, agent, status IS NOT NULL OR agent = 'learner' AS gone, printf('  %s [x%d]: %s (conf=%.2f)', agent, CASE agent WHEN 'ml' THEN 2 WHEN 'learner' THEN 0 ELSE 1 END, recommendation, confidence) AS line FROM votes),
    a AS (SELECT decision_id, count(*) AS n, string_agg(agent, ', ' ORDER BY agent, line) AS names, string_agg(line, chr(10) ORDER BY agent, line) AS lines FROM v WHERE NOT gone GROUP BY decision_id),
    x AS (SELECT decision_id, count(*) AS n, string_agg(agent, ', ' ORDER BY agent, line) AS names FROM v WHERE gone GROUP BY decision_id)
    SELECT decision_id, concat_ws(chr(10), printf('Consensus: %.4f', round(c, 9)), printf('Active agents (%d): %s', coalesce(a.n, 0), coalesce(a.names, 'none')), a.lines, CASE WHEN x.n > 0 THEN printf('Excluded agents (%d): %s', x.n, x.names) END,
        CASE WHEN abs(c) >= 0.6 AND 0.01 * abs(c) <= 0.001 THEN '  >>> BLOCKED by risk' END) AS reasoning FROM s LEFT JOIN a USING (decision_id) LEFT JOIN x USING (decision_id)""")  # fmt: skip
def desk_reasoning(spark, d):
    votes = votes_of(spark, d, cents=True)
    decisions = consensus.decide(consensus.consensus(consensus.usable(votes)), F.lit(0.01))
    return desk.reasoning(votes, decisions.select("decision_id", F.round("consensus", 9).alias("consensus"), "approved"))  # sums of any order print alike


_DESK = """accounts AS (SELECT o_orderpriority AS account, 200000.0 + sum(o_totalprice) / 100 AS cash, 200000.0 + sum(o_totalprice) / 50 AS peak FROM orders GROUP BY 1),
    prices AS (SELECT 'S' || (o_custkey % 40) AS symbol, avg(o_totalprice) / 1000 AS price FROM orders WHERE o_custkey % 40 <> 7 GROUP BY 1),
    positions AS (SELECT o_orderpriority AS account, 'S' || (o_custkey % 40) AS symbol, CASE WHEN count(*) % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, avg(o_totalprice) / 1000 AS entry, CAST(count(*) AS DOUBLE) AS q FROM orders WHERE o_custkey % 40 < 25 GROUP BY 1, 2),
    decisions AS (SELECT o_orderpriority AS account, 'S' || (o_custkey % 40) AS symbol, CASE count(*) % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS action, count(*) % 5 <> 0 AS approved, 0.02 * (1 + count(*) % 7) AS size FROM orders GROUP BY 1, 2),
    h AS (SELECT p.*, price, CASE side WHEN 'LONG' THEN 1 ELSE -1 END * (price - entry) * q AS pnl, CASE side WHEN 'LONG' THEN 1 ELSE -1 END * (price - entry) / entry AS move FROM positions p LEFT JOIN prices USING (symbol)),
    e AS (SELECT *, CASE WHEN move <= -0.02 THEN 'stop_loss' WHEN move >= 0.04 THEN 'take_profit' END AS event, coalesce(CASE side WHEN 'LONG' THEN coalesce(price, entry) * q ELSE pnl END, 0) AS worth FROM h),
    t AS (SELECT account, sum(CASE WHEN event IS NOT NULL THEN worth ELSE 0 END) AS freed, sum(CASE WHEN event IS NULL THEN worth ELSE 0 END) AS worth FROM e GROUP BY account),
    st AS (SELECT account, cash + coalesce(freed, 0) AS cash, cash + coalesce(freed, 0) + coalesce(worth, 0) AS equity, peak FROM accounts LEFT JOIN t USING (account)),
    w AS (SELECT d.account, d.symbol, d.action, price, st.cash, least(size, 0.10) AS share FROM decisions d JOIN prices USING (symbol) JOIN st USING (account) WHERE approved AND action IN ('BUY', 'SELL') AND (peak - equity) / peak <= 0.15
        AND NOT EXISTS (SELECT 1 FROM e WHERE e.account = d.account AND e.symbol = d.symbol AND event IS NULL)),
    o AS (SELECT *, cash * exp(coalesce(sum(CASE WHEN action = 'BUY' THEN ln(1 - share) ELSE 0 END) OVER (PARTITION BY account ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * share AS value FROM w)"""


def _paper(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("account"), F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")).alias("symbol"), (F.col("o_custkey") % 40).alias("k"), "o_totalprice")
    total, mean, n = F.sum("o_totalprice"), F.avg("o_totalprice") / 1000, F.count("*")
    accounts = orders.groupBy("account").agg((200_000 + total / 100).alias("cash"), (200_000 + total / 50).alias("peak"))
    prices = orders.where("k <> 7").groupBy("symbol").agg(mean.alias("price"))
    positions = orders.where("k < 25").groupBy("account", "symbol").agg(F.when(n % 2 == 0, "LONG").otherwise("SHORT").alias("side"), mean.alias("entry_price"), n.cast("double").alias("quantity"), F.lit(0.02).alias("stop_loss"), F.lit(0.04).alias("take_profit"))
    decisions = orders.groupBy("account", "symbol").agg(F.when(n % 3 == 0, "BUY").when(n % 3 == 1, "SELL").otherwise("HOLD").alias("action"), (n % 5 != 0).alias("approved"), (0.02 * (1 + n % 7)).alias("position_size"))
    return desk.paper_scan(accounts, positions, prices, decisions)


@query(f"""WITH {_DESK}, b AS (SELECT account, sum(CASE WHEN action = 'BUY' THEN value ELSE 0 END) AS taken FROM o WHERE value > 0 GROUP BY account)
    SELECT account, round(cash - coalesce(taken, 0), 4) AS cash, round(equity, 4) AS equity, round(greatest(peak, equity), 4) AS peak FROM st LEFT JOIN b USING (account)""")  # fmt: skip
def desk_paper_accounts(spark, d):
    return _paper(spark, d)[0].select("account", *(F.round(c, 4).alias(c) for c in ("cash", "equity", "peak")))


@query(f"""WITH {_DESK} SELECT account, symbol, event, side, round(price, 4) AS price, round(q, 4) AS quantity, round(pnl, 4) AS pnl FROM e WHERE event IS NOT NULL
    UNION ALL SELECT account, symbol, 'open', CASE action WHEN 'BUY' THEN 'LONG' ELSE 'SHORT' END, round(price, 4), round(value / price, 4), 0.0 FROM o WHERE value > 0""")  # fmt: skip
def desk_paper_trades(spark, d):
    return _paper(spark, d)[2].select("account", "symbol", "event", "side", *(F.round(c, 4).alias(c) for c in ("price", "quantity", "pnl")))


@query(f"""WITH {_CROSS}, c AS (SELECT *, least(0.5 + 20 * abs((f - s) / nullif(s, 0)), 0.95) AS conf FROM g WHERE signal <> 'HOLD'),
    r(rule, level, ms, mc) AS (VALUES ('strong_signal', 'WARNING', 0.50, 0.40), ('critical_signal', 'CRITICAL', 0.75, 0.60), ('any_signal', 'INFO', 0.30, 0.0))
    SELECT level, count(*) AS alerts, count(DISTINCT symbol) AS symbols, CAST(max(ts) AS VARCHAR) AS newest FROM c JOIN r ON conf >= ms AND conf >= mc GROUP BY level""")  # fmt: skip
def alerts_summary(spark, d):
    return r6(portfolio.alert_summary(alerts.matches(scored_signals(spark, d), alerts.default_rules(spark))))


@query(f"""WITH RECURSIVE {_CROSS}{_MACD_2}, c AS (SELECT symbol, ts, signal, least(0.5 + 20 * abs((f - s) / nullif(s, 0)), 0.95) AS conf FROM g WHERE signal <> 'HOLD' UNION ALL SELECT symbol, ts, {_MACD_SIGNAL}, 0.6 FROM p2 WHERE {_MACD_SIGNAL} <> 'HOLD'),
    r(rule, level, ms, mc, wait) AS (VALUES ('strong_signal', 'WARNING', 0.50, 0.40, 300), ('critical_signal', 'CRITICAL', 0.75, 0.60, 120), ('any_signal', 'INFO', 0.30, 0.0, 60)),
    a AS MATERIALIZED (SELECT symbol, rule, level, ts, signal, wait, row_number() OVER (PARTITION BY symbol, rule ORDER BY ts, signal) AS k FROM c JOIN r ON conf >= ms AND conf >= mc),
    z AS (SELECT symbol, rule, level, ts, signal, k, ts AS kept, true AS keep FROM a WHERE k = 1 UNION ALL
        SELECT a.symbol, a.rule, a.level, a.ts, a.signal, a.k, CASE WHEN epoch(a.ts) - epoch(z.kept) >= a.wait THEN a.ts ELSE z.kept END, epoch(a.ts) - epoch(z.kept) >= a.wait FROM z JOIN a ON a.symbol = z.symbol AND a.rule = z.rule AND a.k = z.k + 1)
    SELECT symbol, CAST(ts AS VARCHAR) AS ts, signal, rule, level FROM z WHERE keep""")  # fmt: skip
def alerts_watched(spark, d):
    """What a watcher of two strategies sends for all bars."""
    return r6(desk.strategy_alerts(B.hourly_bars(spark, d), ["ma_cross", "macd"], alerts.default_rules(spark)).select("symbol", "ts", "signal", "rule", "level"))


@query("""SELECT page_id, url LIKE 'https://%' AND (split_part(split_part(url, '/', 3), ':', 1) = 'example.net' OR split_part(split_part(url, '/', 3), ':', 1) LIKE '%.example.net') AS allowed FROM pages""")
def alerts_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", alerts.host_allowed("url", ("example.net",)).alias("allowed"))


@query(f"""WITH {_CROSS} SELECT symbol, CAST(ts AS VARCHAR) AS ts, printf('[INFO] any: %s %s (score %+.2f)', signal, symbol, CASE signal WHEN 'SELL' THEN -1 ELSE 1 END * round(least(0.5 + 20 * abs((f - s) / nullif(s, 0)), 0.95), 9)) AS line FROM g WHERE signal <> 'HOLD'""")
def alerts_text(spark, d):
    rows = scored_signals(spark, d).where("signal <> 'HOLD'")
    return rows.select("symbol", F.col("ts").cast("string").alias("ts"), T.alert_text(F.lit("any"), F.lit("INFO"), F.col("symbol"), F.col("signal"), F.round("score", 9)).alias("line"))


# grids, walks, learning


_TITLE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '^(PDF_|EPUB_|DOCX_|CHM_|MOBI_|HTML_)', ''), '_p\d+_i(mg)?\d+\.\w+$', ''), '_i\d+\.\w+$', ''), '\.\w+$', '')"


@query(f"""WITH n AS (SELECT p_partkey, ['PDF_', 'EPUB_', 'DOCX_', 'CHM_', 'MOBI_', 'HTML_', 'DJVU_', 'IMG_', ''][1 + p_partkey % 9] || p_name || ['_p', '_i', '.'][1 + p_size % 3] || CASE p_size % 3 WHEN 0 THEN p_size || '_img' || p_partkey || '.png' WHEN 1 THEN p_size || '.jpeg' ELSE 'gif' END AS name FROM part)
    SELECT p_partkey, name, CASE WHEN regexp_matches(name, '^(PDF_|EPUB_|DOCX_|CHM_|MOBI_|HTML_)') THEN nullif({_TITLE}, '') END AS title FROM n""")
def manifest_image_titles(spark, d):
    """Part names as names of images cut from books of several formats, some of unknown ones."""
    k, size = F.col("p_partkey"), F.col("p_size")
    prefix = F.element_at(F.array(*map(F.lit, ("PDF_", "EPUB_", "DOCX_", "CHM_", "MOBI_", "HTML_", "DJVU_", "IMG_", ""))), (k % 9 + 1).cast("int"))
    end = F.when(size % 3 == 0, F.concat(F.lit("_p"), size.cast("string"), F.lit("_img"), k.cast("string"), F.lit(".png"))).when(size % 3 == 1, F.concat(F.lit("_i"), size.cast("string"), F.lit(".jpeg"))).otherwise(".gif")
    named = table(spark, d, "part").select("p_partkey", F.concat(prefix, "p_name", end).alias("name"))
    return named.withColumn("title", T.title_of_image(F.col("name")))


@query(f"""WITH {BARS}, n AS (SELECT *, CAST(epoch(ts) AS BIGINT) // 3600 AS h FROM bars) SELECT 'record' AS kind, symbol, CAST(ts AS VARCHAR) AS ts, round(close, 6) AS close FROM n WHERE h % 10 <> 0
    UNION ALL SELECT 'reject', symbol, NULL, NULL FROM n WHERE h % 10 = 0""")
def bars_from_json(spark, d):
    """Bars written as lines of JSON, every tenth cut off in its middle: what is read, and what is rejected, of each symbol's folder."""
    root = _scratch(spark, "json")
    bars = B.hourly_bars(spark, d)
    line = F.to_json(F.struct(F.col("ts").cast("string").alias("Date"), F.col("close").alias("C"), F.col("volume").alias("Vol")))
    cut = F.when(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600 % 10 == 0, F.expr("substring(line, 1, length(line) div 2)")).otherwise(F.col("line"))
    bars.select("symbol", "ts", line.alias("line")).select("symbol", cut.alias("value")).write.partitionBy("symbol").text(root)
    read = tolerant.read_json(spark, root).withColumn("symbol", F.regexp_extract("path", "symbol=([^/]+)", 1))
    good = tolerant.as_columns(read, ["date", "c"]).withColumn("symbol", F.regexp_extract("path", "symbol=([^/]+)", 1))
    good = good.select(F.lit("record").alias("kind"), "symbol", F.col("date").alias("ts"), F.round(F.col("c").cast("double"), 6).alias("close"))
    return good.unionByName(read.where("record IS NULL").select(F.lit("reject").alias("kind"), "symbol"), allowMissingColumns=True)


@query()
def text_knowledge(spark, d):
    """Chunks of each document in a store that got half of the documents, then all, then all again under the same name."""
    store = knowledge.KnowledgeStore(spark, _scratch(spark, "knowledge"))
    documents = table(spark, d, "documents").select("doc_id", "text")
    store.add(documents.where("doc_id % 2 = 0"), "half")
    for _ in range(2):
        store.add(documents, "all")
    return store.chunks().groupBy("doc_id").agg(F.count("*").alias("chunks"), F.countDistinct("chunk_key").alias("keys"), F.sum("token_estimate").alias("tokens"))


@query()
def manifest_books(spark, d):
    """Part names as images of books, the names of other parts, with a word less and another order, as the library: which book each is from."""
    part = table(spark, d, "part")
    images = part.select("p_partkey", F.concat(F.lit("charts/PDF_"), F.initcap(F.regexp_replace("p_name", " ", "-")), F.lit("_p"), F.col("p_size").cast("string"), F.lit("_img1.png")).alias("path"))
    words = F.split("p_name", " ")
    books = part.where("p_partkey % 3 = 0").select(F.concat(F.array_join(F.concat(F.slice(words, 2, 9), F.slice(words, 1, 1)), " "), F.lit(" (Z-Library).pdf")).alias("book"), F.col("p_partkey").alias("position"), F.col("p_type").alias("topic"))
    return r6(manifest.books_of_images(images, books.groupBy("book").agg(F.min("position").alias("position"), F.min_by("topic", "position").alias("topic"))).select("p_partkey", "title", "book", "topic", "score"))


@query(f"""WITH {BARS}, f AS (SELECT * REPLACE (CASE WHEN CAST(epoch(ts) AS BIGINT) // 3600 % 3 = 0 THEN high ELSE close END AS close), CASE WHEN symbol = 'click' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS f FROM bars WHERE low > 0)
    SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(open * f, 6) AS open, round(high * f, 6) AS high, round(low * f, 6) AS low, round(close * f, 6) AS close, volume / f AS volume FROM f""")
def bars_loaded(spark, d):
    """Bars written as CSV files, with impossible and repeated rows after good ones, found by an index and loaded."""
    return r6(load_written(spark, d))


def load_written(spark, d):
    """Hourly bars of each symbol as a CSV file: at some hours the bar comes again, at some with high below low; prices of `click` were halved since."""
    root = _scratch(spark, "loads")
    bars = B.hourly_bars(spark, d).where("low > 0")
    hour = (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    again = bars.where(hour % 3 == 0).withColumns({"close": F.col("high"), "row": F.lit(1)})
    worse = bars.where(hour % 4 == 0).withColumns({"high": F.col("low") - 1, "row": F.lit(2)})
    rows = bars.withColumn("row", F.lit(0)).unionByName(again).unionByName(worse)
    rows = rows.withColumn("Adj Close", F.when(F.col("symbol") == "click", F.col("close") / 2).otherwise(F.col("close")))
    rows.repartition("symbol").sortWithinPartitions("symbol", "ts", "row").select("symbol", F.col("ts").alias("Date"), "Open", "High", "Low", "Close", "Adj Close", "Volume").write.partitionBy("symbol").option("header", True).csv(root)
    names = sorted(r.symbol for r in bars.select("symbol").distinct().collect())  # a symbol is an event's type, a few names
    index = spark.createDataFrame([(f"{root}/symbol={s}", f"{s.upper()}_1H", "csv") for s in names], "path string, key string, ext string")
    return B.load(spark, index, names, "1h").drop("adj_close")


def _close(when: str, cash: str, side: str, entry: str, q: str) -> str:
    """Cash after a close of the position at the bar's price, if `when`."""
    fill = f"(close * (1 - {side} * least(greatest(0.0005 * (1 + coalesce({q} * close / nullif(adv * close, 0), 0)), 0.0001), 0.005)))"
    fee = f"greatest({fill} * {q} * 0.001, 1)"
    return f"{cash} + CASE WHEN {when} THEN CASE WHEN {side} > 0 THEN {fill} * {q} ELSE {side} * ({fill} - {entry}) * {q} END - {fee} ELSE 0 END"


def _trade(when: str, side: str, entry: str, q: str, fee: str, since: str, at: str, reason: str) -> str:
    """That close as a row, null without one."""
    fill = f"(close * (1 - {side} * least(greatest(0.0005 * (1 + coalesce({q} * close / nullif(adv * close, 0), 0)), 0.0001), 0.005)))"
    out = f"greatest({fill} * {q} * 0.001, 1)"
    pnl = f"({side} * ({fill} - {entry}) * {q} - {out})"
    return f"""CASE WHEN {when} THEN {{'side': CASE WHEN {side} > 0 THEN 'LONG' ELSE 'SHORT' END, 'entry_ts': {at}, 'entry_price': {entry}, 'exit_price': {fill}, 'quantity': {q}, 'pnl': {pnl},
        'commission': {fee} + {out}, 'pnl_pct': {pnl} / ({entry} * {q}), 'reason': {reason}, 'hold_bars': k - {since}}} END"""


_TRADE = "STRUCT(side VARCHAR, entry_ts TIMESTAMP, entry_price DOUBLE, exit_price DOUBLE, quantity DOUBLE, pnl DOUBLE, commission DOUBLE, pnl_pct DOUBLE, reason VARCHAR, hold_bars BIGINT)"
#: The steps of a bar, each of which sees the columns of those before it.
_STEPS = [
    "side0 * (close - entry0) / nullif(entry0, 0) AS move, CASE WHEN halted0 OR signal = 'HOLD' THEN 0 WHEN signal = 'BUY' THEN 1 ELSE -1 END AS s",
    "side0 <> 0 AND (move <= -st OR move >= tk) AS x1",
    f"{_close('x1', 'cash0', 'side0', 'entry0', 'q0')} AS cash1, CASE WHEN x1 THEN 0 ELSE side0 END AS side1",
    "s <> 0 AND side1 = -s AS x2",
    f"{_close('x2', 'cash1', 'side1', 'entry0', 'q0')} AS cash2, CASE WHEN x2 THEN 0 ELSE side1 END AS side2",
    "cash2 * 0.02 AS v, greatest(cash2 * 0.02 * 0.001, 1) AS fee",
    "s <> 0 AND side2 = 0 AND v > fee AS opens",
    "CASE WHEN opens THEN s ELSE side2 END AS side3, CASE WHEN opens THEN close * (1 + s * least(greatest(0.0005 * (1 + coalesce(v / nullif(adv * close, 0), 0)), 0.0001), 0.005)) ELSE entry0 END AS entry3, cash2 - CASE WHEN NOT opens THEN 0 WHEN s > 0 THEN v ELSE fee END AS cash3",
    "CASE WHEN opens THEN (v - fee) / entry3 ELSE q0 END AS q3, CASE WHEN opens THEN fee ELSE fee0 END AS fee3, CASE WHEN opens THEN k ELSE since0 END AS since3, CASE WHEN opens THEN ts ELSE at0 END AS at3",
    "CASE side3 WHEN 0 THEN cash3 WHEN 1 THEN cash3 + close * q3 ELSE cash3 + (entry3 - close) * q3 END AS now3",
    "greatest(peak0, now3) AS peak3",
    "NOT halted0 AND (peak3 - now3) / peak3 > 0.15 AS x4",
    f"{_close('x4 AND side3 <> 0', 'cash3', 'side3', 'entry3', 'q3')} AS cash4, CASE WHEN x4 THEN 0 ELSE side3 END AS side4",
    "k = n AND side4 <> 0 AS x5",
    f"{_close('x5', 'cash4', 'side4', 'entry3', 'q3')} AS cash5, CASE WHEN x5 THEN 0 ELSE side4 END AS side5",
    "CASE WHEN side5 = 0 THEN cash5 ELSE now3 END AS equity, CAST(x1 AS INTEGER) + CAST(x2 AS INTEGER) + CAST(x4 AND side3 <> 0 AS INTEGER) + CAST(x5 AS INTEGER) AS closed",
    _trade("x1 OR x2", "side0", "entry0", "q0", "fee0", "since0", "at0", "CASE WHEN x2 THEN 'signal_reversal' WHEN move <= -st THEN 'stop_loss' ELSE 'take_profit' END") + " AS ta",
    _trade("(x4 AND side3 <> 0) OR x5", "side3", "entry3", "q3", "fee3", "since3", "at3", "CASE WHEN x5 THEN 'end_of_data' ELSE 'circuit_breaker' END") + " AS tb",
]
_BAR = "SELECT b.symbol, b.ts, b.k, n, close, signal, st, tk, adv, cash0, side0, entry0, q0, peak0, halted0, fee0, since0, at0 FROM z JOIN b ON b.symbol = z.symbol AND b.k = z.k + 1"
for _step in _STEPS:
    _BAR = f"SELECT *, {_step} FROM ({_BAR})"
#: Runs of the signals of a table g (symbol, ts, signal) on bars; the stop and profit are columns there, or those of most strategies.
_ROWS = "SELECT symbol, ts, c.close, signal, 0.02::DOUBLE AS st, 0.04::DOUBLE AS tk, avg(c.volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS adv, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM g JOIN bars c USING (symbol, ts)"
_RUN = f"""{_CROSS}, b AS MATERIALIZED ({_ROWS}),
    z AS (SELECT symbol, NULL::TIMESTAMP AS ts, 0::BIGINT AS k, 100000.0::DOUBLE AS cash0, 0 AS side0, 0.0::DOUBLE AS entry0, 0.0::DOUBLE AS q0, 100000.0::DOUBLE AS peak0, false AS halted0, 0.0::DOUBLE AS fee0, 0::BIGINT AS since0, NULL::TIMESTAMP AS at0, 0.0::DOUBLE AS equity, 0 AS closed, NULL::{_TRADE} AS ta, NULL::{_TRADE} AS tb FROM (SELECT DISTINCT symbol FROM b)
        UNION ALL SELECT symbol, ts, k, cash5, side5, entry3, q3, peak3, halted0 OR x4, fee3, since3, at3, equity, closed, ta, tb FROM ({_BAR}))"""


@query(f"WITH RECURSIVE {_RUN} SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(equity, 4) AS equity, closed FROM z WHERE k > 0")
def backtest_equity(spark, d):
    """Equity and closed trades of the moving-average strategy after every bar."""
    steps = backtest.simulate(signals.ma_crossover(B.hourly_bars(spark, d)))
    return steps.select("symbol", F.col("ts").cast("string").alias("ts"), F.round("equity", 4).alias("equity"), F.size("trades").alias("closed"))


@query()
def backtest_grid(spark, d):
    """Every symbol and one that has no bars with three strategies and one that is unknown."""
    bars = B.hourly_bars(spark, d)
    symbols = bars.select("symbol").distinct().unionByName(spark.createDataFrame([("none",)], "symbol string"))
    jobs = symbols.crossJoin(F.broadcast(spark.createDataFrame([("ma_cross",), ("bollinger",), ("macd",), ("other",)], "strategy string")))
    # null where a job has no run, so a double on every side
    return r6(desk.backtest_grid(bars, jobs, ["ma_cross", "bollinger", "macd"]).withColumn("total_trades", F.col("total_trades").cast("double")))


#: Bars of the parts of five anchored windows, once for each strategy: symbol is strategy|symbol|window|part.
_PARTS = f"""{BARS.replace("bars AS", "whole AS", 1)}, counted AS (SELECT *, row_number() OVER {W}) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS total FROM whole),
    cut AS (SELECT c.*, w, CAST(floor(total * CAST(0.6 AS DOUBLE)) AS BIGINT) + w * greatest(1, CAST(floor(total * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS a, greatest(1, CAST(floor(total * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS width FROM counted c, range(5) t(w)),
    bars AS MATERIALIZED (SELECT s || '|' || symbol || '|' || w || CASE WHEN r < a THEN '|train' ELSE '|test' END AS symbol, ts, open, high, low, close, volume FROM cut, (VALUES ('ma_cross'), ('macd')) t(s) WHERE r < least(a + width, total) AND least(a + width, total) - a >= 10)"""
_WALK = f"""{_CROSS.replace(BARS, _PARTS)}{_MACD_2},
    g2 AS (SELECT symbol, ts, signal FROM g WHERE starts_with(symbol, 'ma_cross|') UNION ALL SELECT symbol, ts, {_MACD_SIGNAL} FROM p2 WHERE starts_with(symbol, 'macd|'))"""
_WALK = _RUN.replace(_CROSS, _WALK).replace("FROM g JOIN bars", "FROM g2 JOIN bars").replace("peak3 > 0.15 AS", "peak3 > 1.0 AS")
#: Bars of each symbol once for each of four strategies, and the runs of their signals: symbol is strategy|symbol.
_EACH = f"""{BARS.replace("bars AS", "whole AS", 1)}, bars AS MATERIALIZED (SELECT s || '|' || symbol AS symbol, ts, open, high, low, close, volume FROM whole, (VALUES ('ma_cross'), ('rsi_reversion'), ('bollinger'), ('macd')) t(s))"""
_FOUR = f"""{_CROSS.replace(BARS, _EACH)}{_MACD_2},
    rc AS (SELECT *, coalesce(close - lag(close) OVER {W}), 0) AS ch FROM bars), rg AS (SELECT *, greatest(ch, 0) AS gain, greatest(-ch, 0) AS loss FROM rc), rm AS (SELECT *, {sql_roll("avg", "gain", 14)} AS mg, {sql_roll("avg", "loss", 14)} AS ml FROM rg),
    rr AS (SELECT *, CASE WHEN ml = 0 AND mg > 0 THEN 100 ELSE 100 - 100 / (1 + mg / nullif(ml, 0)) END AS r FROM rm), rp AS (SELECT *, lag(r) OVER {W}) AS r1, lag(r, 2) OVER {W}) AS r2 FROM rr),
    bm AS (SELECT *, {sql_roll("avg", "close", 20)} AS mid, {sql_roll("stddev_samp", "close", 20)} AS sd FROM bars), bb AS (SELECT *, (close - (mid - 2 * sd)) / nullif(4 * sd, 0) AS p FROM bm), bq AS (SELECT *, lag(p) OVER {W}) AS p1 FROM bb),
    g4 AS (SELECT symbol, ts, signal, 0.02::DOUBLE AS st, 0.04::DOUBLE AS tk FROM g WHERE starts_with(symbol, 'ma_cross|') UNION ALL SELECT symbol, ts, {_MACD_SIGNAL}, 0.02, 0.04 FROM p2 WHERE starts_with(symbol, 'macd|')
        UNION ALL SELECT symbol, ts, CASE WHEN r2 < 30 AND r1 < 30 AND r > 30 THEN 'BUY' WHEN r2 > 70 AND r1 > 70 AND r < 70 THEN 'SELL' ELSE 'HOLD' END, 0.015, 0.03 FROM rp WHERE starts_with(symbol, 'rsi_reversion|')
        UNION ALL SELECT symbol, ts, CASE WHEN p1 < 0.05 AND p > 0.05 THEN 'BUY' WHEN p1 > 0.95 AND p < 0.95 THEN 'SELL' ELSE 'HOLD' END, 0.02, 0.03 FROM bq WHERE starts_with(symbol, 'bollinger|'))"""
_FOUR = _RUN.replace(_CROSS, _FOUR).replace("0.02::DOUBLE AS st, 0.04::DOUBLE AS tk, avg(c.volume)", "st, tk, avg(c.volume)").replace("FROM g JOIN bars", "FROM g4 JOIN bars")
#: Hours between bars to bars a year, days for runs of ten bars or fewer.
_YEAR = "CASE WHEN n <= 10 OR m IS NULL THEN 252.0 WHEN m < 0.1 THEN 98280.0 WHEN m < 0.2 THEN 19656.0 WHEN m < 0.5 THEN 6552.0 WHEN m < 2 THEN 1638.0 WHEN m < 8 THEN 409.5 WHEN m < 48 THEN 252.0 WHEN m < 240 THEN 52.0 ELSE 12.0 END"


#: Names of the same classes of spacings.
_FRAME = "CASE WHEN n <= 10 OR m IS NULL THEN '1d' WHEN m < 0.1 THEN '1m' WHEN m < 0.2 THEN '5m' WHEN m < 0.5 THEN '15m' WHEN m < 2 THEN '1h' WHEN m < 8 THEN '4h' WHEN m < 48 THEN '1d' WHEN m < 240 THEN '1wk' ELSE '1mo' END"
#: Trades and reports of the four strategies' runs.
_TRADES = f"""{_FOUR}, y0 AS MATERIALIZED (SELECT symbol, ts, k, equity, ta, tb FROM z WHERE k > 0),
    tr AS MATERIALIZED (SELECT split_part(symbol, '|', 2) AS symbol, split_part(symbol, '|', 1) AS strategy, ts AS exit_ts, unnest(t) FROM (SELECT symbol, ts, unnest(list_filter([ta, tb], lambda x: x IS NOT NULL)) AS t FROM y0)),
    ts AS (SELECT symbol, strategy, count(*) AS n_trades, CAST(count(*) FILTER (pnl > 0) AS BIGINT) AS n_wins, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, least(999.0::DOUBLE, coalesce(sum(pnl) FILTER (pnl > 0), 0) / CASE WHEN coalesce(sum(pnl) FILTER (pnl <= 0), 0) = 0 THEN 1 ELSE abs(sum(pnl) FILTER (pnl <= 0)) END) AS profit_factor,
        coalesce(avg(pnl_pct) FILTER (pnl > 0), 0) AS mean_win_pct, coalesce(avg(pnl_pct) FILTER (pnl <= 0), 0) AS mean_loss_pct, sum(commission) AS commission, avg(hold_bars) AS mean_hold FROM tr GROUP BY ALL)"""
_REPORT = f"""{_TRADES}, y1 AS (SELECT *, max(equity) OVER {W} ROWS UNBOUNDED PRECEDING) AS peak, (equity - lag(equity) OVER {W})) / nullif(lag(equity) OVER {W}), 0) AS ret, (epoch(ts) - epoch(lag(ts) OVER {W}))) / 3600 AS h FROM y0),
    y2 AS (SELECT *, (equity - peak) / nullif(peak, 0) AS dd FROM y1), y3 AS (SELECT *, sum(CAST(dd >= 0 AS BIGINT)) OVER {W} ROWS UNBOUNDED PRECEDING) AS island FROM y2), y4 AS (SELECT *, sum(CAST(dd < 0 AS BIGINT)) OVER (PARTITION BY symbol, island) AS under FROM y3),
    y5 AS (SELECT symbol, arg_max(equity, ts) AS final_equity, max(-dd) AS max_drawdown, CAST(max(under) AS BIGINT) AS longest_drawdown, avg(ret) AS mean, stddev_pop(ret) AS sd, coalesce(stddev_pop(ret) FILTER (ret < 0), 1) AS neg, median(h) AS m, count(*) AS n FROM y4 GROUP BY symbol),
    y6 AS (SELECT split_part(symbol, '|', 2) AS symbol, split_part(symbol, '|', 1) AS strategy, final_equity, final_equity / 100000 - 1 AS total_return, max_drawdown, longest_drawdown, coalesce(mean / nullif(sd, 0) * sqrt({_YEAR}), 0) AS sharpe, coalesce(mean / nullif(neg, 0) * sqrt({_YEAR}), 0) AS sortino,
        coalesce((final_equity / 100000 - 1) / nullif(max_drawdown, 0), 0) AS calmar, {_FRAME} AS timeframe FROM y5),
    rep AS (SELECT y6.*, coalesce(n_trades, 0) AS n_trades, coalesce(n_wins, 0) AS n_wins, coalesce(win_rate, 0) AS win_rate, coalesce(profit_factor, 0) AS profit_factor, coalesce(mean_win_pct, 0) AS mean_win_pct, coalesce(mean_loss_pct, 0) AS mean_loss_pct, coalesce(commission, 0) AS commission, coalesce(mean_hold, 0) AS mean_hold FROM y6 LEFT JOIN ts USING (symbol, strategy))"""
_RATES = ", ".join(f"round({c}, 6) AS {c}" for c in ("win_rate", "profit_factor", "mean_win_pct", "mean_loss_pct", "commission", "mean_hold"))

ORACLE_SQL["backtest_trades"] = f"""WITH RECURSIVE {_TRADES} SELECT symbol, strategy, CAST(exit_ts AS VARCHAR) AS exit_ts, side, CAST(entry_ts AS VARCHAR) AS entry_ts, {", ".join(f"round({c}, 6) AS {c}" for c in ("entry_price", "exit_price", "quantity", "pnl", "commission", "pnl_pct"))}, reason, hold_bars FROM tr"""
ORACLE_SQL["backtest_report"] = f"""WITH RECURSIVE {_REPORT} SELECT symbol, strategy, longest_drawdown, timeframe, n_trades, n_wins, {", ".join(f"round({c}, 6) AS {c}" for c in ("final_equity", "total_return", "max_drawdown", "sharpe", "sortino", "calmar"))}, {_RATES} FROM rep"""
ORACLE_SQL["backtest_best"] = f"""WITH RECURSIVE {_REPORT} SELECT symbol, strategy, round(sharpe, 6) AS sharpe, round(total_return, 6) AS total_return FROM rep QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, strategy DESC) = 1"""
ORACLE_SQL["backtest_metrics_by_trade"] = f"""WITH RECURSIVE {_TRADES} SELECT symbol, strategy, n_trades, n_wins, {_RATES} FROM ts WHERE strategy IN ('ma_cross', 'macd')"""
ORACLE_SQL["backtest_grid"] = f"""WITH RECURSIVE {_REPORT}, jobs AS (SELECT symbol, strategy FROM (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'none'), (VALUES ('ma_cross'), ('bollinger'), ('macd'), ('other')) t(strategy))
    SELECT jobs.symbol, jobs.strategy AS strategy_name, {", ".join(f"round({ours}, 6) AS {name}" for name, ours in desk.GRID.items() if name not in ("symbol", "strategy_name", "total_trades"))}, CAST(n_trades AS DOUBLE) AS total_trades, CASE WHEN jobs.strategy = 'other' THEN 'unknown strategy: other' WHEN final_equity IS NULL THEN 'no_data' END AS error
    FROM jobs LEFT JOIN rep USING (symbol, strategy)"""


@query(f"""WITH RECURSIVE {_WALK}, y1 AS (SELECT *, (equity - lag(equity) OVER {W})) / nullif(lag(equity) OVER {W}), 0) AS ret, (epoch(ts) - epoch(lag(ts) OVER {W}))) / 3600 AS h FROM z WHERE k > 0),
    y2 AS (SELECT symbol, arg_max(equity, ts) / 100000 - 1 AS total_return, avg(ret) AS mean, stddev_pop(ret) AS sd, median(h) AS m, count(*) AS n, count(ta.pnl) + count(tb.pnl) AS trades, count(*) FILTER (ta.pnl > 0) + count(*) FILTER (tb.pnl > 0) AS wins FROM y1 GROUP BY symbol),
    y3 AS (SELECT string_split(symbol, '|') AS k, total_return, coalesce(mean / nullif(sd, 0) * sqrt({_YEAR}), 0) AS sharpe, coalesce(wins / nullif(trades, 0), 0) AS win_rate FROM y2),
    y4 AS (SELECT k[2] AS symbol, k[1] AS strategy, k[3] AS w, max(sharpe) FILTER (k[4] = 'train') AS a, max(sharpe) FILTER (k[4] = 'test') AS b, max(total_return) FILTER (k[4] = 'test') AS tr, max(win_rate) FILTER (k[4] = 'test') AS wr FROM y3 GROUP BY ALL),
    y5 AS (SELECT symbol, strategy, avg(b) AS mean_sharpe, avg(tr) AS mean_return, avg(wr) AS mean_win_rate, coalesce(avg(CASE WHEN b <> 0 THEN least(a / b, 10.0) END), 0) AS overfit, count(*) AS n, stddev_pop(b) AS sd FROM y4 GROUP BY ALL),
    y6 AS (SELECT *, CASE WHEN n < 2 OR mean_sharpe = 0 THEN 0 ELSE greatest(1 - abs(sd / mean_sharpe), -1) END AS stability FROM y5)
    SELECT symbol, strategy, round(mean_sharpe, 6) AS mean_sharpe, round(mean_return, 6) AS mean_return, round(mean_win_rate, 6) AS mean_win_rate, round(overfit, 6) AS overfit, round(stability, 6) AS stability, stability > 0.5 AS stable FROM y6""")  # fmt: skip
def learn_walk_backtests(spark, d):
    """A backtest of each part of the anchored windows of every symbol, and what they say together."""
    return r6(desk.walk_forward_report(B.hourly_bars(spark, d), ["ma_cross", "macd"]))


@query()
def learn_cross_validated(spark, d):
    """Trees trained afresh on each of three folds of every symbol's series: accuracies and their overfit."""
    df = features.direction_target(features.native_features(B.hourly_bars(spark, d), "null"))
    rows = splits.assign_own_folds(df, folds=3, gap=5)
    return r6(splits.fold_summary(learn.cross_validate(rows, ["rsi", "bb_position", "volume_ratio", "returns", "volatility_20"], "price_up", trees=3, depth=3), ["model"]))


@query(f"""WITH {BARS}, n AS (SELECT symbol, (close > lag(close) OVER {W})) = (lead(close) OVER {W}) > close) AS hit, row_number() OVER {W}) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
    a AS (SELECT symbol, avg(CAST(hit AS DOUBLE)) FILTER (r < floor(n * CAST(0.8 AS DOUBLE))) AS train, avg(CAST(hit AS DOUBLE)) FILTER (r >= floor(n * CAST(0.8 AS DOUBLE))) AS test FROM n GROUP BY symbol)
    SELECT symbol, round(train, 6) AS train, round(test, 6) AS test, round(CASE WHEN test <= 0 THEN 'Infinity'::DOUBLE ELSE train / test END, 6) AS overfit, test > 0.70 AS suspicious, CASE WHEN test <= 0 THEN true ELSE train / test > 1.5 END AS overfitted FROM a""")  # fmt: skip
def learn_flags(spark, d):
    """How often the last change tells the sign of the next, in the first four fifths of a symbol's bars and in the rest, with flags."""
    w = Window.partitionBy("symbol").orderBy("ts")
    hit = (F.col("close") > F.lag("close").over(w)) == (F.lead("close").over(w) > F.col("close"))
    rows = B.hourly_bars(spark, d).select("symbol", hit.cast("double").alias("hit"), (F.row_number().over(w) - 1 < F.floor(F.count("*").over(Window.partitionBy("symbol")) * F.lit(0.8))).alias("early"))
    scores = rows.groupBy("symbol").agg(F.avg(F.when(F.col("early"), F.col("hit"))).alias("train"), F.avg(F.when(~F.col("early"), F.col("hit"))).alias("test"))
    return r6(learn.accuracy_flags(scores))


@query("""SELECT doc_id, CASE quality WHEN 1 THEN 'BUY' ELSE 'SELL' END AS two, CASE quality + toxic WHEN 2 THEN 'BUY' WHEN 0 THEN 'SELL' ELSE 'HOLD' END AS three FROM labels""")
def learn_actions(spark, d):
    """The classes of labels as predictions of a model of two and of one of three classes."""
    return table(spark, d, "labels").select("doc_id", learn.prediction_action(F.col("quality"), 2).alias("two"), learn.prediction_action(F.col("quality") + F.col("toxic"), 3).alias("three"))


# bars, cleaning and features that were constants


@query(f"""WITH {BARS}, t(timeframe) AS (VALUES ('1m'), ('2m'), ('5m'), ('15m'), ('30m'), ('1h'), ('4h'), ('1d'), ('1wk'), ('1mo'), ('x')), m(timeframe, interval, period) AS (VALUES ('1m', '1m', '7d'), ('2m', '2m', '60d'), ('5m', '5m', '60d'), ('15m', '15m', '60d'), ('30m', '30m', '60d'), ('1h', '1h', '730d'), ('4h', '1h', '730d'), ('1d', '1d', 'max'), ('1wk', '1wk', 'max'))
    SELECT symbol, timeframe, coalesce(m.interval, '1h') AS interval, coalesce(m.period, '730d') AS period FROM (SELECT DISTINCT symbol FROM bars), t LEFT JOIN m USING (timeframe)""")  # fmt: skip
def bars_requests(spark, d):
    frames = spark.createDataFrame([(t,) for t in ("1m", "2m", "5m", "15m", "30m", "1h", "4h", "1d", "1wk", "1mo", "x")], "timeframe string")
    asked = B.hourly_bars(spark, d).select("symbol").distinct().crossJoin(F.broadcast(frames))  # eleven rows
    return asked.select("symbol", "timeframe", B.request_of(F.col("timeframe")).alias("r")).select("symbol", "timeframe", "r.*")


@query(f"""WITH {BARS}, n AS (SELECT *, hour(ts) % 5 = 0 AS a, hour(ts) % 7 = 0 AS b FROM bars) SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(CASE WHEN NOT a THEN close END, 6) AS close, CASE WHEN NOT b THEN volume END AS volume FROM n WHERE NOT (a AND b)""")
def clean_empty(spark, d):
    """Bars whose prices, or volumes, are made null at some hours: rows without any go."""
    a, b = F.hour("ts") % 5 == 0, F.hour("ts") % 7 == 0
    bars = B.hourly_bars(spark, d).select("symbol", "ts", *(F.when(~a, F.col(c)).alias(c) for c in ("open", "high", "low", "close")), F.when(~b, F.col("volume")).alias("volume"))
    return r6(cleaning.drop_empty(bars).select("symbol", "ts", "close", "volume"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'BTC-USD' WHEN 1 THEN 'EURUSD=X' WHEN 2 THEN 'GC=F' WHEN 3 THEN '^GSPC' ELSE 'AAPL' END AS ticker, CASE o_orderkey % 5 WHEN 0 THEN 'crypto' WHEN 1 THEN 'forex' WHEN 2 THEN 'tech_stocks' WHEN 3 THEN 'indices' ELSE 'tech_stocks' END AS category FROM orders""")
def clean_tickers(spark, d):
    name = F.element_at(F.array(*map(F.lit, (" btc", "eurusd", "Gold", "spx", "aapl "))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    named = table(spark, d, "orders").select("o_orderkey", cleaning.ticker(name).alias("ticker"))
    return named.withColumn("category", cleaning.symbol_category(F.col("ticker"), {"crypto": ["BTC-USD", "ETH-USD"]}))


@query(f"WITH {BARS} SELECT symbol, CAST(ts AS VARCHAR) AS ts, 0 AS source_file, 0.0::DOUBLE AS dividends, CASE WHEN symbol = 'click' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS stock_splits, round(close, 6) AS adj_close FROM bars")
def features_constants(spark, d):
    bars = B.hourly_bars(spark, d).withColumn("stock_splits", F.when(F.col("symbol") == "click", 2.0))
    return r6(features.with_constants(bars).select("symbol", "ts", "source_file", "dividends", "stock_splits", "adj_close"))


# catalogs, counts, checks

_KEYS = "keys AS (SELECT page_id, regexp_replace(upper(regexp_extract(url, '://([^/?#]*)', 1)), '[.]', '_', 'g') AS key FROM pages)"


@query(f"WITH {_KEYS} SELECT regexp_replace(key, '_[^_]*$', '') AS symbol, count(*) AS files FROM keys GROUP BY 1")
def files_symbols(spark, d):
    key = F.regexp_replace(F.upper(F.regexp_extract("url", "://([^/?#]*)", 1)), "[.]", "_")
    return files_.listed_symbols(table(spark, d, "pages").select(key.alias("key")))


@query("""WITH r AS (SELECT url AS path, length(html) AS size_bytes, row_number() OVER (ORDER BY length(html) DESC, url) AS rank FROM pages) SELECT path, size_bytes, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def files_largest(spark, d):
    return files_.largest(table(spark, d, "pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("size_bytes")))


@query("""WITH v AS (SELECT 'lang' AS "column", lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) SELECT "column", value, count(*) AS count FROM v GROUP BY ALL""")
def text_value_counts(spark, d):
    return docs.value_counts(table(spark, d, "documents"), ["lang", "source"])


@query("""SELECT 'lang' AS "column", count(DISTINCT lang) AS n FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents UNION ALL SELECT 'text', count(DISTINCT text) FROM documents""")
def text_distinct(spark, d):
    return docs.distinct_counts(table(spark, d, "documents"), ["lang", "source", "text"])


_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


@query(f"""WITH l AS (SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM l),
    c AS (SELECT doc_id, word, count(*) AS n, min(place) AS fst FROM w WHERE length(word) > 3 AND word NOT IN {_STOP} GROUP BY doc_id, word), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fst) AS k FROM c),
    f AS (SELECT word, count(*) AS documents FROM k WHERE k <= 10 GROUP BY word), r AS (SELECT *, row_number() OVER (ORDER BY documents DESC, word) AS rank FROM f) SELECT word, documents, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")  # fmt: skip
def text_document_frequency(spark, d):
    return docs.document_frequency(docs.keywords(table(spark, d, "documents")))


@query("""SELECT count(*) AS transcripts, CAST(sum(n) AS BIGINT) AS cues, CAST(sum(w) AS BIGINT) AS words, round(sum(CAST(n AS DOUBLE)) / 3600, 6) AS hours FROM
    (SELECT conv_id, count(*) AS n, sum(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))) AS w FROM conversations GROUP BY conv_id)""")  # fmt: skip
def text_transcript_totals(spark, d):
    """Conversations as transcripts: a turn is a cue of a second."""
    rows = table(spark, d, "conversations")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    made = rows.groupBy("conv_id").agg(F.count("*").alias("cues"), F.count("*").cast("double").alias("duration_s"), F.sum(words).cast("long").alias("words"))
    return r6(docs.transcript_totals(made))


@query("""SELECT o_orderkey, printf('%02d:%02d:%02d', CAST(o_totalprice AS BIGINT) // 3600, (CAST(o_totalprice AS BIGINT) % 3600) // 60, CAST(o_totalprice AS BIGINT) % 60) AS hms FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)""")
def text_hms(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.seconds_to_hms(F.col("o_totalprice")).alias("hms"))


@query("""SELECT c.conv_id, c.turn, d.lang, d.source, CAST(l.quality AS VARCHAR) AS quality FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id LEFT JOIN labels l ON l.doc_id = c.conv_id""")
def text_enriched(spark, d):
    """Turns as chunks, documents with their labels as the catalog."""
    catalog = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id", "left")
    return docs.enrich(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn"), catalog).select(F.col("doc_id").alias("conv_id"), "turn", "lang", "source", "quality")


@query("""SELECT count(*) AS chunks, count(DISTINCT sha256(coalesce(text, ''))) AS chunk_ids, count(DISTINCT conv_id) AS documents, CAST(sum(CAST(coalesce(text, '') = '' AS BIGINT)) AS BIGINT) AS empty FROM conversations""")
def text_index_check(spark, d):
    text = F.coalesce("text", F.lit(""))
    return docs.verify_index(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("chunk_key")))


@query("""WITH p AS (SELECT page_id, list_slice(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), 1, -2) AS dirs FROM pages), e AS (SELECT page_id, unnest(dirs) AS name, generate_subscripts(dirs, 1) AS pos FROM p WHERE len(dirs) <= 3),
    t(name, topic) AS (VALUES ('en', 'english'), ('de', 'german'), ('es', 'spanish')), f AS (SELECT page_id, arg_max(topic, pos) AS topic FROM e JOIN t ON lower(trim(e.name)) = t.name GROUP BY page_id) SELECT page_id, topic FROM pages LEFT JOIN f USING (page_id)""")  # fmt: skip
def manifest_topics(spark, d):
    topics = spark.createDataFrame([("EN", "english"), (" de ", "german"), ("es", "spanish")], "name string, topic string")
    files = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return manifest.directory_topics(files, topics).select("page_id", "topic")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'CatBoost' WHEN 1 THEN 'sklearn (pickle)' ELSE 'PyTorch' END AS kind, p_size % 2 = 0 AS verified FROM part""")
def account_models(spark, d):
    """Parts as model files: what they are by extension and first bytes, and whether their hash is the registered one."""
    k = F.col("p_size") % 3
    ext = F.when(k == 0, "cbm").when(k == 1, "pkl").otherwise("pt")
    models = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("name"), T.model_kind(ext, F.lit("..sklearn.ensemble..")).alias("kind"), F.sha2(F.col("p_name"), 256).alias("sha256"))
    registry = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_size") % 2 == 0, F.sha2(F.col("p_name"), 256)).otherwise("other").alias("sha256"))
    return portfolio.verified_models(models, registry).select("p_partkey", "kind", "verified")


@query(f"""WITH {_VOTES}, {_WEIGHTS} SELECT agent, count(*) AS votes, round(coalesce(max(weight), 0.1), 6) AS weight, count(status) AS stubs FROM votes LEFT JOIN w USING (agent) GROUP BY agent""")
def votes_agents(spark, d):
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for a, (w, m) in consensus.WEIGHTS.items() for x in (a, w * m))), F.col("agent")), F.lit(0.1))
    return r6(votes_of(spark, d).groupBy("agent").agg(F.count("*").alias("votes"), F.max(weight).alias("weight"), F.count_if(F.col("status").isNotNull()).alias("stubs")))


_FIRST = f"WITH {BARS}, n AS (SELECT *, row_number() OVER {W}) - 1 AS k FROM bars)"


@query(_FIRST + " SELECT symbol, count(*) AS bars, round(first(close ORDER BY ts), 6) AS first_close FROM n WHERE k < 100 GROUP BY symbol")
def bars_head(spark, d):
    """The first 100 bars of each symbol, a top list of each key."""
    rows = desk.top(B.hourly_bars(spark, d), [F.col("ts")], 100, ["symbol"])
    return r6(rows.groupBy("symbol").agg(F.count("*").alias("bars"), F.min_by("close", "ts").alias("first_close")))


@query()
def backtest_metrics_by_trade(spark, d):
    """Trade statistics of the runs from the rows of their trades: they equal what `backtest_report` gathers."""
    return r6(backtest.trade_stats(backtest.trades_of(backtest.simulate(signals.signals(B.hourly_bars(spark, d), ["ma_cross", "macd"])))))


@query()
def vectors_index(spark, d):
    """The ten nearest of every vector whose id is divisible by 20, from an index of all vectors calibrated to nine tenths and more."""
    vectors = table(spark, d, "embeddings")
    index = vector_index.VectorIndex.build(vectors, _scratch(spark, "index"))
    return r6(index.search(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10))


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def vectors_index_whole(spark, d):
    """An index built on half of the vectors, the rest added in two batches, one of them twice; all cells visited, so the result is exact."""
    vectors = table(spark, d, "embeddings")
    index = vector_index.VectorIndex.build(vectors.where("vec_id % 2 = 0"), _scratch(spark, "index"))
    index.add(vectors.where("vec_id % 4 = 1"), "a")
    for _ in range(2):
        index.add(vectors.where("vec_id % 4 <> 1 OR vec_id IS NULL"), "b")
    return r6(index.search(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, probes=len(index.centres)))
