"""Paper accounts that live from scan to scan: each micro-batch is scanned against the state that the one before committed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.desk import POSITIONS, paper_scan
from tidemark.sources.commits import Commits

ACCOUNTS = "account string, cash double, equity double, peak double"
TRADES = "scan bigint, account string, symbol string, event string, side string, price double, quantity double, pnl double"
#: What a stream of scans holds: rows with an account are decisions, the others quotes.
SCANS = "scan bigint, symbol string, price double, account string, action string, approved boolean, position_size double, stop_loss double, take_profit double"


class PaperDesk:
    """Accounts, positions and trades below a folder, one commit a micro-batch.

    The folder belongs to one stream's checkpoint: batches are told apart by their id. A batch that comes again after a stop (the engine repeats
    the one it can't be sure of) finds its commit and changes nothing; one that stopped before its commit starts from the same state.
    """

    def __init__(self, accounts: DataFrame, root: str) -> None:
        self.spark, self.commits = accounts.sparkSession, Commits(accounts.sparkSession, root)
        self.accounts = accounts.select("account", "cash", F.col("peak").alias("equity"), "peak")

    def state(self, batch: int) -> tuple[DataFrame, DataFrame]:
        """(accounts, positions) after a batch; before the first, what there was at the start."""
        if batch < 0:
            return self.accounts, self.spark.createDataFrame([], POSITIONS)
        return self.commits.read(batch, "accounts", ACCOUNTS), self.commits.read(batch, "positions", POSITIONS)

    def trades(self) -> DataFrame:
        return self.commits.read_all("trades", TRADES)

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Runs the scans of a batch (SCANS) in order and commits what they leave. A batch holds one scan, or a few."""
        if self.commits.done(batch):
            return
        rows = rows.persist()  # read once for each scan and side
        accounts, positions = self.state(batch - 1)
        done = self.spark.createDataFrame([], TRADES)
        for (scan,) in rows.select("scan").distinct().orderBy("scan").collect():
            own = rows.where(F.col("scan") == scan)
            prices, decisions = own.where("account IS NULL").select("symbol", "price"), own.where("account IS NOT NULL").drop("scan", "price")
            accounts, positions, trades = paper_scan(accounts.drop("equity"), positions, prices, decisions)
            done = done.unionByName(trades.select(F.lit(scan).cast("long").alias("scan"), "*"))
        self.commits.write(batch, {"accounts": accounts, "positions": positions, "trades": done})
        rows.unpersist()


def stream_scans(scans: DataFrame, desk: PaperDesk, checkpoint: str) -> None:
    """Runs a stream of scans (SCANS) over all that is there."""
    scans.writeStream.foreachBatch(desk.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
