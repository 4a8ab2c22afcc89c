"""Tags and titles: trimming, acts, songs and artists out of titles, keys and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}]"
#: Fixed values, as they decide what counts as an act: a dash between artist and song, with white space on one side
#: at least; and a guest, a word that white space follows.
DASH = r"\s+[-–—]\s+|\s+[-–—]|[-–—]\s+"
GUEST = r"(?i)\s+(feat\.?|ft\.?|featuring|with)\s.*$"
UNKNOWN = "<unknown>"
#: Bounds of an artist found in a title, and of one to display.
HEAD_MOST, ACT_LEAST, ARTIST_MOST = 60, 2, 40


def trimmed(c: Column) -> Column:
    """Without white space of any script at both ends; trim() takes U+0020 alone."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def contains(c: Column, query: str | Column) -> Column:
    q = F.lit(query) if isinstance(query, str) else query
    return F.contains(F.lower(c), F.lower(q))


def _parts(title: Column) -> Column:
    return F.split(trimmed(title), DASH, 2)


def _head(title: Column) -> Column:
    return F.regexp_replace(trimmed(_parts(title)[0]), r"^[_. ]+|[_. ]+$", "")


def artist_in_title(title: Column) -> Column:
    """The act before the first dash of a title, lower-cased and without guests; null if none."""
    parts = _parts(title)
    head = _head(title)
    lead = F.regexp_replace(head, GUEST, "")
    act = F.lower(trimmed(lead))
    good = (F.size(parts) == 2) & (trimmed(F.get(parts, F.lit(1))) != "") & F.length(head).between(ACT_LEAST, HEAD_MOST) & head.rlike(r"\p{L}") & (F.length(act) >= ACT_LEAST)
    return F.when(good, act)


def song_in_title(title: Column) -> Column:
    return F.when(artist_in_title(title).isNotNull(), trimmed(F.get(_parts(title), F.lit(1)))).otherwise(trimmed(title))


def act_of(artist: Column, title: Column, folder: Column) -> Column:
    """Whose a track is: its tag, else the artist in its title, else its folder."""
    tag = F.lower(trimmed(F.coalesce(artist, F.lit("Unknown"))))
    return F.coalesce(F.when((tag != "") & (tag != UNKNOWN), tag), artist_in_title(title), F.lower(trimmed(folder)))


def artist_of(artist: Column, title: Column) -> Column:
    """The artist to display, in its own case; null if neither tag nor title has one."""
    tag = trimmed(artist)
    at = F.instr(title, " - ")
    head = trimmed(F.regexp_replace(F.substring(title, F.lit(1), at - 1), r"^[\d. ]+", ""))
    return F.when((F.lower(tag) != UNKNOWN) & tag.rlike(r"\p{L}"), tag).when((at > 1) & F.length(head).between(ACT_LEAST, ARTIST_MOST) & head.rlike(r"\p{L}"), head)


def duplicate_key(artist: Column, title: Column, folder: Column) -> Column:
    return F.concat_ws("|", act_of(artist, title, folder), F.lower(song_in_title(title)))


def is_cyrillic(c: Column) -> Column:
    return c.rlike("[а-яА-ЯёЁ]")


def clock(ms: Column) -> Column:
    """Minutes and seconds."""
    s = F.floor(ms / 1000)
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def day_of(ms: Column) -> Column:
    """The calendar date, in the session's time zone."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def until_next_day(ms: Column) -> Column:
    """Milliseconds to the next midnight of the session's time zone, when a day's playlist is built anew; a second at least."""
    midnight = F.date_add(F.to_date(F.timestamp_millis(ms)), 1).cast("timestamp")
    return F.greatest(F.lit(1000), F.unix_millis(midnight) - ms).cast("long")


def seconds_left(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """What is left of a scan at its mean pace so far, in whole milliseconds a track; 0 before the first."""
    pace = F.when(done > 0, F.floor(elapsed_ms / done)).otherwise(F.lit(0))
    return F.floor((total - done) * pace / 1000).cast("long")


def art_uri(album_id: Column) -> Column:
    """Where Android keeps an album's picture; null without an album."""
    return F.concat(F.lit("content://media/external/audio/albumart/"), album_id.cast("string"))


def size_text(b: Column) -> Column:
    """A number of bytes in GB, MB or KB."""

    def written(unit: int, name: str) -> Column:
        return F.format_string(f"%.1f {name}", b / F.lit(float(unit)))

    return F.when(b >= 1 << 30, written(1 << 30, "GB")).when(b >= 1 << 20, written(1 << 20, "MB")).otherwise(written(1 << 10, "KB"))


def snapped(value: Column, steps: int, least: float, most: float) -> Column:
    """A slider's value: the nearest of so many steps to one, within its bounds."""
    return F.round(F.least(F.lit(most), F.greatest(F.lit(least), value)) * steps) / steps


def hash_uniform(seed: Column | str | int, key: Column) -> Column:
    """A number strictly between 0 and 1 that depends on seed and key alone, the same in any engine with md5."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", seed, key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double")
    return (h + 0.5) / 4294967296.0
