"""String functions against plain Python forms of the same rules."""

import re
import unicodedata

from pyspark.sql import functions as F

from geoloom.functions import strings as S


def one(spark, values, kind, work):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"id int, v {kind}")
    return [r.out for r in df.select("id", work(F.col("v")).alias("out")).orderBy("id").collect()]


def test_tokens_fold_every_letter_that_decomposes(spark):
    names = ["Timișoara Việt", "Łódź", "ﬁeld ﬀ", "Ｆｕｌｌ １２", "½ way", "東京 Tower", "𝐀lpha", "st. mary's", "", None, "Ǆep ㎏", "Ærø ß", "_a__b_"]

    def plain(text):
        text = "".join(S.ATOMIC.get(c, c) for c in re.sub("['\"`]", "", text or ""))
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
        joined = "".join(w[:1].upper() + w[1:] for w in text.split())
        return re.sub("_{2,}", "_", re.sub("[^A-Za-z0-9_]+", "_", joined)).strip("_")

    assert one(spark, names, "string", S.sanitize_token) == [plain(n) for n in names]


def test_keys_are_masked_whatever_stands_before_them(spark):
    urls = ["http://h/?subscription_key=SECRET", "mykey=a b&x=1", "?API_Key%3Dzz&token=key=1", "key=&k=2", "?accesskey=1", "?access_token=1&password=2", None, ""]

    def plain(url):
        for name in S.SECRET_KEYS:
            for sign in ("=", "%3D"):
                url = re.sub(f"({name}{sign})[^&]+", r"\1***", url, flags=re.IGNORECASE)
        return url

    assert one(spark, urls, "string", S.mask_secrets) == [u if u is None else plain(u) for u in urls]


def test_sizes_have_one_decimal_in_every_unit(spark):
    sizes = [0, 500, 1023, 1024, 1280, 1792, 5 * 1024**3, 3 * 1024**4 + 1, 2**60, 1048575, 153, None]

    def plain(n):
        for unit in ("B", "KB", "MB", "GB"):
            if n < 1024:
                return f"{n:.1f} {unit}"
            n /= 1024
        return f"{n:.1f} TB"

    assert one(spark, sizes, "long", S.human_size) == [n if n is None else plain(n) for n in sizes]
    assert plain(500) == "500.0 B" and plain(5 * 1024**3) == "5.0 GB"


def test_levels_and_loggers(spark):
    assert one(spark, ["DEBUG", "Info", "WARNING", "critical", None], "string", S.log_level) == ["info", "info", "warning", "error", "info"]
    names = ["main", "mainly", "services", "services.x", "servicesx", "middleware.y", "uvicorn", ""]
    assert one(spark, names, "string", S.app_logger) == [True, True, True, True, False, True, False, False]


def test_folding_takes_time_linear_in_the_text(spark):
    """No character of a long text meets the list of all long characters one by one."""
    import time

    spark.range(1).select(S.folded(F.lit("é"))).collect()
    text = spark.range(1).select(F.repeat(F.lit("Vägen är låg. "), 150_000).alias("v"))
    start = time.time()
    assert text.select(F.md5(S.folded(F.col("v"))) == F.md5(F.repeat(F.lit("Vagen ar lag. "), 150_000))).first()[0]
    assert time.time() - start < 8
