"""Frame, clip and label paths."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from footstats.vocab import BATCH_SECONDS

# Fixed formats: .../mat_MM/BBBB/FFFF.jpg for frames, [Mat+M ...] in recording names.
FRAME_PATTERN = r"([^/_]*)/(\d+)/(\d+)\.[^/]*$"
MAT_PATTERN = r"\[Mat\+(\d+)"


def frame_mat(path: Column) -> Column:
    return F.regexp_extract(path, FRAME_PATTERN, 1).try_cast("int")


def frame_batch(path: Column) -> Column:
    return F.regexp_extract(path, FRAME_PATTERN, 2).try_cast("int")


def frame_number(path: Column) -> Column:
    return F.regexp_extract(path, FRAME_PATTERN, 3).try_cast("int")


def frame_timestamp(path: Column) -> Column:
    return frame_batch(path) * BATCH_SECONDS + frame_number(path)


def clip_file(path: Column) -> Column:
    """``a/b/0001/0007.jpg`` -> ``a/b/0001.mp4``: the clip a frame was taken from."""
    return F.concat(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(".mp4"))


def clip_second(path: Column) -> Column:
    """``a/b/0001/0007.jpg`` -> 7."""
    return F.regexp_extract(path, r"/(\d+)[^/]*$", 1).try_cast("long")


def url_tail(url: Column, n: int) -> Column:
    """The last ``n`` parts of a path or URL."""
    return F.array_join(path_tail(url, n), "/")


def path_tail(path: Column, n: int) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n)


def strip_prefix(path: Column, prefix: str) -> Column:
    return F.replace(path, F.lit(prefix), F.lit(""))


def crop_to_frame(path: Column, suffix: str = ".jpg") -> Column:
    """``dir/0398_00.png`` -> ``dir/0398.jpg``: cut the name at its first underscore, else at its extension."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.concat(F.regexp_replace(stem, r"_[^/]*$", ""), F.lit(suffix))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mat_key(filename: Column) -> Column:
    return F.regexp_extract(filename, MAT_PATTERN, 1).try_cast("int")
