"""Text expressions: sentiment, hints, titles, patterns, counts, ids, times. The lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of rising and falling news.
BULLISH = [
    "surge", "soar", "rally", "breakout", "upgrade", "beat", "exceeded",
    "record high", "all-time high", "bullish", "outperform", "growth",
    "strong earnings", "positive", "optimistic", "recovery", "boom",
    "buy rating", "price target raised", "momentum", "upside",
    "beat expectations", "strong demand", "expansion", "profit",
]
BEARISH = [
    "crash", "plunge", "decline", "downgrade", "miss", "warning",
    "record low", "bearish", "underperform", "recession", "slump",
    "weak earnings", "negative", "pessimistic", "selloff", "sell-off",
    "sell rating", "price target cut", "downturn", "downside",
    "missed expectations", "weak demand", "contraction", "loss",
    "bankruptcy", "layoffs", "investigation", "fraud", "default",
]
# Terms of direction in books.
BULLISH_TERMS = [
    "buy", "long", "bullish", "accumulation", "support", "breakout", "uptrend", "demand zone", "order block bullish", "buy signal",
    "golden cross", "oversold", "reversal up", "higher high", "higher low", "bull flag", "ascending",
]
BEARISH_TERMS = [
    "sell", "short", "bearish", "distribution", "resistance", "breakdown", "downtrend", "supply zone", "sell signal", "death cross",
    "overbought", "reversal down", "lower low", "lower high", "bear flag", "descending",
]
# Path parts that rule a book out, and words that speak for one.
EXCLUDED = [
    "nhs", "nursing", "medical", "health", "anatomy", "physiology", "biology", "chemistry", "physics", "dentistry", "veterinary",
    "recipes", "cooking", "fitness", "diet", "nutrition", "photography", "music", "art", "crafts",
    "recycle bin", "$recycle.bin", "system volume information", "asta_nu", "arhive",
]
RELEVANT = [
    "trading", "trader", "market", "stock", "forex", "crypto", "options", "futures", "commodities", "investing", "investment",
    "portfolio", "hedge", "arbitrage", "algorithmic", "algo", "technical analysis", "fundamental analysis", "candlestick",
    "fibonacci", "elliott wave", "price action", "order flow", "risk management", "money management", "quantitative", "quant",
    "backtest", "machine learning", "data science", "statistics", "probability", "stochastic", "volatility", "derivative",
    "bond", "equity", "fixed income", "etf", "mutual fund", "behavioral finance", "economics", "macroeconomics",
    "microstructure", "smart money", "ict", "wyckoff", "supply demand", "support resistance", "breakout", "momentum",
    "mean reversion", "trend following", "scalping", "swing", "day trading", "position trading", "fintech", "blockchain",
    "python", "programming", "deep learning", "neural network", "time series", "regression", "classification", "nlp",
    "pandas", "numpy", "tensorflow", "pytorch", "scikit",
]
# Chart patterns and directions by words in a file's path.
PATTERNS = {
    "head_and_shoulders": ["head_and_shoulders", "headandshoulders", "h&s", "head_shoulder", "hs_pattern", "inverse_head"],
    "double_top": ["double_top", "doubletop", "double-top", "dbl_top"],
    "double_bottom": ["double_bottom", "doublebottom", "double-bottom", "dbl_bottom"],
    "triangle": ["triangle", "ascending_triangle", "descending_triangle", "symmetrical_triangle", "triunghi"],
    "channel": ["channel", "ascending_channel", "descending_channel", "price_channel", "canal"],
    "flag": ["flag", "bull_flag", "bear_flag", "pennant"],
    "wedge": ["wedge", "rising_wedge", "falling_wedge"],
    "cup_and_handle": ["cup_and_handle", "cupandhandle", "cup_handle"],
    "support_resistance": ["support", "resistance", "s_r", "sr_level"],
    "trend": ["uptrend", "downtrend", "trend", "trendline"],
    "candlestick": ["candlestick", "doji", "hammer", "engulfing", "marubozu", "spinning_top", "morning_star", "evening_star", "harami"],
    "fibonacci": ["fibonacci", "fib_", "fibo", "retracement"],
    "elliott_wave": ["elliott", "wave_count", "impulse_wave", "corrective_wave"],
}
DIRECTIONS = {
    "bullish": ["bullish", "bull", "long", "buy", "up", "ascending", "rising"],
    "bearish": ["bearish", "bear", "short", "sell", "down", "descending", "falling"],
    "neutral": ["neutral", "sideways", "range", "consolidation", "flat"],
}
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had"]


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _total(parts: list[Column]) -> Column:
    """Sum of columns as a balanced tree: a chain of so many would be slow to plan."""
    while len(parts) > 1:
        parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) - len(parts) % 2 :]
    return parts[0]


def present(low: Column, words: list[str]) -> Column:
    """How many of the words occur in a lower-cased text."""
    return _total([F.contains(low, F.lit(w)).cast("int") for w in words])


def occurrences(low: Column, words: list[str]) -> Column:
    """How often the words occur in a lower-cased text, each without overlaps.

    Literal splits, of which only the number of parts is used, run in compiled code; the text is lower-cased once, by the caller.
    """
    return _total([F.when(F.contains(low, F.lit(w)), F.size(F.split(low, w.replace(".", "[.]"), -1)) - 1).otherwise(0) for w in words])


def keyword_sentiment(low: Column) -> Column:
    """(rising - falling) / all words present in a lower-cased text, 0 without any."""
    up, down = present(low, BULLISH), present(low, BEARISH)
    return F.coalesce(F.try_divide((up - down).cast("double"), up + down), F.lit(0.0))


def direction_hint(bullish: Column, bearish: Column) -> Column:
    """struct<direction, confidence> of the two counts."""
    share = F.try_divide(bullish.cast("double"), bullish + bearish)
    direction = F.when(share > 0.6, "BULLISH").when(share < 0.4, "BEARISH").otherwise("NEUTRAL")
    confidence = F.when(share > 0.6, F.least(0.3 + (share - 0.6) * 2, F.lit(0.7))).when(share < 0.4, F.least(0.3 + (0.4 - share) * 2, F.lit(0.7))).when(share.isNotNull(), 0.2).otherwise(0.0)
    return F.struct(direction.alias("direction"), F.round(confidence, 2).alias("confidence"))


def sentiment_vote(sentiment: Column, articles: Column) -> Column:
    """struct<recommendation, confidence>."""
    recommendation = F.when(sentiment > 0.2, "BUY").when(sentiment < -0.2, "SELL").otherwise("HOLD")
    return F.struct(recommendation.alias("recommendation"), (0.7 * F.least(F.abs(sentiment), F.lit(1.0)) + 0.3 * F.least(articles / 5, F.lit(1.0))).alias("confidence"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


# What is cut out of file names, in this order.
TITLE_MARKS = [(r"(?i)[-_]?z[-_]?lib(rary)?", ""), (r"(?i)[-_]?pdfdrive", ""), (r"(?i)[-_]?libgen", ""), (r"[a-f0-9]{8,}", ""), (r"\([^)]*\)", ""), (r"\[[^\]]*\]", ""), (r"[_\-]+", " "), (r"\b\d{5,}\b", ""), (r"\s+", " ")]


def normalize_title(path: Column) -> Column:
    """A book's title from its file name: without site marks, hashes, brackets, long numbers; spaces and case evened."""
    title = file_stem(path)
    for pattern, to in TITLE_MARKS:
        title = F.regexp_replace(title, pattern, to)
    return F.lower(F.trim(title))


def is_relevant(path: Column) -> Column:
    """True where the path, or its stem with spaces for `_` and `-`, holds a relevant word, and the path none that rules it out."""
    low = F.lower(path)
    both = F.concat(low, F.lit(" "), F.translate(F.lower(file_stem(path)), "_-", "  "))
    return ~F.exists(_words(EXCLUDED), lambda w: F.contains(low, w)) & F.exists(_words(RELEVANT), lambda w: F.contains(both, w))


def chart_pattern(path: Column) -> Column:
    """The first pattern with a word in the last three parts of the path; "unlabeled" without."""
    even = lambda c: F.regexp_replace(F.lower(c), "[_-]", " ")
    parts = F.split(path, "/")
    last = even(F.array_join(F.reverse(F.slice(F.reverse(parts), 1, 3)), " "))
    tests = [F.when(F.exists(_words([w.replace("_", " ").replace("-", " ") for w in words]), lambda w: F.contains(last, w)), name) for name, words in PATTERNS.items()]
    return F.coalesce(*tests, F.lit("unlabeled"))


def chart_direction(path: Column) -> Column:
    """The first direction with a whole word in the last two parts of the path; "unknown" without."""
    last = F.regexp_replace(F.lower(F.array_join(F.reverse(F.slice(F.reverse(F.split(path, "/")), 1, 2)), " ")), "[_-]", " ")
    return F.coalesce(*(F.when(last.rlike(r"\b(?:" + "|".join(words) + r")\b"), name) for name, words in DIRECTIONS.items()), F.lit("unknown"))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def chunk_id(path: Column, number: Column, text: Column) -> Column:
    return F.concat(F.lit("rag_"), F.substring(F.sha2(F.concat_ws(":", path, number.cast("string"), F.substring(text, 1, 100)), 256), 1, 16))


def cache_key(query: Column, n: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lower(F.trim(query)), n.cast("string")), 256), 1, 16)


def timecode_seconds(code: Column) -> Column:
    """Seconds of HH:MM:SS,mmm; 0 for anything else."""
    parts = F.split(F.replace(code, F.lit(","), F.lit(".")), ":")
    total = F.get(parts, 0).try_cast("int") * 3600 + F.get(parts, 1).try_cast("int") * 60 + F.get(parts, 2).try_cast("double")
    return F.coalesce(total.cast("double"), F.lit(0.0))


def seconds_to_hms(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def fixed(value: Column, digits: int, plus: bool = False) -> Column:
    """A number with `digits` decimals, rounded from its exact binary value with ties to even (`format_string` rounds the shortest decimal up)."""
    text = F.call_function("format_number", value, F.lit("0." + "0" * digits))
    return F.when(value >= 0, F.concat(F.lit("+"), text)).otherwise(text) if plus else text


def human_size(n: Column) -> Column:
    """Bytes as text with one decimal."""
    out = F.concat(fixed(n / float(1 << 50), 1), F.lit(" PB"))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < float(1 << 10 * (k + 1)), F.concat(fixed(n / float(1 << 10 * k), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def plain_text(text: Column, n: int = 200) -> Column:
    return F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f]", ""), 1, n)


def reply_sentiment(reply: Column) -> Column:
    """`sentiment` of the first flat JSON object after `</think>`, kept within [-1, 1]; null if there is none."""
    found = F.regexp_extract(F.substring_index(reply, "</think>", -1), r"\{[^}]+\}", 0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.get_json_object(found, "$.sentiment").try_cast("double")))


# Prefixes of image names that say which kind of book they come from; what is cut out of titles and of image names.
FORMATS = ["PDF_", "EPUB_", "DOCX_", "CHM_", "MOBI_", "HTML_"]
BOOK_MARKS = [r"^\d{5,}-", r"(?i)-PDFDrive$", r"(?i)-PDFConverted-\d+$", r"(?i)\s*\(Z-Library\)$", r"(?i)\s*\(\s*PDFDrive\s*\)$"]
IMAGE_MARKS = [r"_p\d+_i(?:mg)?\d+\.\w+$", r"_i\d+\.\w+$", r"\.\w+$"]


def normalize_book_title(title: Column) -> Column:
    """A title without a leading number and site marks at its end, hyphens and underscores as spaces, lower case."""
    for pattern in BOOK_MARKS:
        title = F.regexp_replace(title, pattern, "")
    return F.lower(F.trim(F.regexp_replace(F.translate(title, "-_", "  "), r"\s+", " ")))


def title_of_image(name: Column) -> Column:
    """The book's title in an image's name <format>_<title>_p<page>_i<number>.<ext>; null without a known format."""
    rest = name
    for pattern in (r"^(?:" + "|".join(FORMATS) + ")", *IMAGE_MARKS):
        rest = F.regexp_replace(rest, pattern, "")
    return F.when(name.rlike(r"^(?:" + "|".join(FORMATS) + ")") & (rest != ""), rest)


def model_kind(ext: Column, head: Column) -> Column:
    """The library of a model file by its extension, or by names in the first bytes (as text) of a pickle."""
    low = F.lower(head)
    inside = F.coalesce(*(F.when(F.contains(low, F.lit(w)), f"{name} (pickle)") for w, name in (("catboost", "CatBoost"), ("xgb", "XGBoost"), ("lightgbm", "LightGBM"), ("sklearn", "sklearn"), ("scaler", "Scaler"))), F.lit("pickle (unknown)"))
    known = {"cbm": "CatBoost", "onnx": "ONNX", "safetensors": "SafeTensors", "pt": "PyTorch", "pth": "PyTorch", "h5": "HDF5/Keras"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), ext), F.when(ext.isin("pkl", "joblib"), inside))


def compact_citation(source: Column, text: Column) -> Column:
    return F.concat(F.lit("["), source, F.lit("] "), F.substring(text, 1, 150))


def alert_text(rule: Column, level: Column, symbol: Column, signal: Column, score: Column) -> Column:
    return F.format_string("[%s] %s: %s %s (score %s)", level, rule, signal, symbol, fixed(score, 2, plus=True))
