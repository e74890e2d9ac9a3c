"""Profile links, platforms and canonical addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.names import is_channel_id
from rosterlake.functions.steps import once, step
from rosterlake.functions.values import strip
from rosterlake.vocab import words

PARTS = ("platform", "handle", "channel_id", "legacy_username", "custom_url", "note")


def platform_from_text(c: Column) -> Column:
    """Platform named in free text: short codes must stand alone, longer names may be part of it."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return (F.when(text.contains("insta"), "instagram").when(text == "ig", "instagram")
            .when(text.contains("youtube"), "youtube").when(text == "yt", "youtube")
            .when(text.contains("thread"), "threads")
            .when(text.contains("tiktok") | text.contains("tik tok"), "tiktok"))


def platform_from_file_name(c: Column) -> Column:
    """Platform hinted at by a file name (A4); the extension stays attached to the last part."""
    low = F.lower(c)
    parts = F.split(low, "_")
    hint = F.lit(None).cast("string")
    hint = F.when(F.array_contains(parts, "ig") | low.contains("insta"), "instagram").otherwise(hint)
    hint = F.when(F.array_contains(parts, "yt"), "youtube").otherwise(hint)
    for platform in reversed(words.PLATFORMS):
        hint = F.when(low.contains(platform), platform).otherwise(hint)
    return hint


def with_profile_ref(df: DataFrame, src: str, hint: str, out: str, hosts: dict[str, str] | None = None) -> DataFrame:
    """Add a struct that says which account a link, handle or channel id points to, and why not when it does not.

    ``hosts`` maps a host to the platform whose path rules apply; subdomains count as the host.
    """
    hosts = hosts or words.PLATFORM_HOSTS
    any_host = "|".join(re.escape(h) for h in hosts)
    made = step(df, _s=F.btrim(strip(F.coalesce(F.col(src), F.lit(""))), F.lit("\"'<>")))
    low = F.lower("_s")
    full = F.when(low.startswith("http"), F.col("_s")).otherwise(F.concat(F.lit("https://"), F.col("_s")))
    token = strip(F.ltrim("_s", F.lit("@")))
    made = step(made, _is_url=F.col("_s").contains("/") | low.rlike(f"^(http|www\\.)|{any_host}"), _full=full, _token=token,
                _token_is_channel=is_channel_id(token))
    netloc = F.lower(F.regexp_extract("_full", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1))
    path = F.regexp_extract("_full", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    made = step(made, _host=F.regexp_replace(netloc, r"^(www\.|m\.|mobile\.)", ""),
                _path=F.filter(F.split(F.regexp_replace(path, ";[^/]*$", ""), "/"), lambda p: p != ""))
    site = F.lit(None).cast("string")
    for host, platform in reversed(list(hosts.items())):
        site = F.when((F.col("_host") == host) | F.col("_host").endswith("." + host), platform).otherwise(site)
    p1 = F.try_element_at("_path", F.lit(1))
    made = step(made, _site=site, _p1=p1, _p2=F.try_element_at("_path", F.lit(2)), _person=F.lower(F.ltrim(p1, F.lit("@"))))

    given = F.col("_s") != ""
    url, bare = given & F.col("_is_url"), given & ~F.col("_is_url")
    token, is_channel, person = F.col("_token"), F.col("_token_is_channel"), F.col("_person")
    site_col, p1, p2 = F.col("_site"), F.col("_p1"), F.col("_p2")
    has_path = url & p1.isNotNull()
    social = has_path & site_col.isin("instagram", "threads")
    tiktok, video_site = has_path & (site_col == "tiktok"), has_path & (site_col == "youtube")
    is_video = (F.col("_host") == "youtu.be") | p1.isin(*words.VIDEO_PATHS)
    channel_page = video_site & ~is_video
    at = p1.startswith("@")
    keyed = {key: channel_page & ~at & (p1 == key) & p2.isNotNull() for key in ("channel", "user", "c")}
    handle = (F.when(bare & ~is_channel, F.when(F.col(hint) == "youtube", token).otherwise(F.lower(token)))
              .when(social & ~person.isin(*words.POST_PATHS), person)
              .when(tiktok & at, F.lower(F.substr(p1, F.lit(2))))
              .when(channel_page & at, F.substr(p1, F.lit(2))))
    note = (F.when(url & p1.isNull(), "url_without_path")
            .when(social & person.isin(*words.POST_PATHS), "post_url_not_profile")
            .when(tiktok & ~at, "tiktok_url_not_profile")
            .when(video_site & is_video, "video_url_not_channel")
            .when(has_path & site_col.isNull(), "unknown_host"))
    parts = {
        "platform": F.when(bare & is_channel, "youtube").otherwise(
            F.coalesce(F.when(url, site_col), F.col(hint))),
        "handle": handle,
        "channel_id": F.when(bare & is_channel, token).when(keyed["channel"], p2),
        "legacy_username": F.when(keyed["user"], p2),
        "custom_url": F.when(keyed["c"], p2).when(
            channel_page & ~at & ~keyed["channel"] & ~keyed["user"], p1),
        "note": note,
    }
    made = once(made, **{out: F.struct(*[parts[p].alias(p) for p in PARTS])})
    return made.drop("_s", "_is_url", "_full", "_token", "_token_is_channel", "_host", "_path", "_site", "_p1", "_p2", "_person")


def canonical_url(platform: Column, handle: Column, channel_id: Column) -> Column:
    """The one address a profile is shown under."""
    pages = {"instagram": ("https://www.instagram.com/", "/"), "threads": ("https://www.threads.net/@", ""),
             "tiktok": ("https://www.tiktok.com/@", ""), "youtube": ("https://www.youtube.com/@", "")}
    named = F.nullif(handle, F.lit(""))
    url = F.when((platform == "youtube") & channel_id.isNotNull(),
                 F.concat(F.lit("https://www.youtube.com/channel/"), channel_id))
    for site, (head, tail) in pages.items():
        url = url.when(platform == site, F.concat(F.lit(head), named, F.lit(tail)))
    return url


def video_id(c: Column) -> Column:
    """The eleven-character video id in a post link, null when the link is not one."""
    link = r"(?:youtu\.be/|youtube\.com/(?:watch\?v=|shorts/|live/|embed/))([A-Za-z0-9_-]{11})"
    return F.nullif(F.regexp_extract(c, link, 1), F.lit(""))
