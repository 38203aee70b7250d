"""Video links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts whose links name a video.
HOSTS = ["youtube.com", "youtu.be", "youtube-nocookie.com", "music.youtube.com"]
# What an id looks like, and the paths that hold one.
ID = r"[\w-]{11}"
PATHS = "shorts|embed|v|live"


def video_id(link: Column) -> Column:
    """The id in a bare id, a watch link, a short link, or a shorts, embed, v or live path; null otherwise."""
    link = F.trim(link)
    full = F.when(link.contains("//"), link).otherwise(F.concat(F.lit("https://"), link))
    host = F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^(www|m)\.", "")
    path = F.try_parse_url(full, F.lit("PATH"))
    found = lambda text, pattern: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))
    short = found(path, rf"^/+({ID})(?:/|$)")
    query = found(F.try_parse_url(full, F.lit("QUERY"), F.lit("v")), rf"^({ID})$")
    return (
        F.when(link.rlike(rf"^{ID}$"), link)
        .when(~F.coalesce(host.isin(HOSTS), F.lit(False)), None)
        .when(host == "youtu.be", short)
        .otherwise(F.coalesce(query, found(path, rf"^/(?:{PATHS})/({ID})")))
    )
