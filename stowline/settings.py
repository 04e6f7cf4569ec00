"""Fixed values and size limits."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Results depend on these lists being exactly as they are.
EXTENSIONS = {
    "Images": ["jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "tiff", "tif", "ico", "heic", "raw",
        "psd"],
    "Documents": ["pdf", "doc", "docx", "txt", "rtf", "odt", "md", "epub", "tex", "pages"],
    "Videos": ["mp4", "mkv", "avi", "mov", "webm", "flv", "wmv", "m4v", "mpg", "mpeg", "3gp"],
    "Audio": ["mp3", "wav", "flac", "aac", "ogg", "wma", "m4a", "opus", "aiff"],
    "Archives": ["zip", "rar", "7z", "tar", "gz", "bz2", "xz", "tgz", "tbz2", "iso"],
    "Programs": ["exe", "msi", "app", "deb", "rpm", "bat", "cmd", "sh", "apk", "dmg"],
    "Code": ["py", "js", "ts", "jsx", "tsx", "html", "css", "java", "cpp", "c", "h", "hpp", "cs", "go",
        "rs", "rb", "php", "swift", "kt", "sql", "json", "yaml", "yml", "xml", "toml", "ini", "vue",
        "sass", "scss", "lua", "pl", "r"],
    "Spreadsheets": ["xls", "xlsx", "ods", "csv", "tsv"],
    "Presentations": ["ppt", "pptx", "odp", "key"],
    "Other": [],
}
CATEGORIES = list(EXTENSIONS)
OTHER = "Other"
QUARANTINE = "Duplicate_Review"
IGNORED_NAMES = CATEGORIES + [
    QUARANTINE, "data", "logs", "__pycache__", ".git", ".venv", "venv", "node_modules",
]
OPERATION_TYPES = ["ORGANIZE", "DUPLICATE_REVIEW", "UNDO"]
REVERSIBLE_TYPES = ["ORGANIZE", "DUPLICATE_REVIEW"]
STATUSES = ["SUCCESS", "FAILED"]
SOURCE_GONE = "Source file does not exist (deleted meanwhile)."
FILE_MISSING = "File missing"
PREVIEW_MOVES = 50
LISTED_PATHS = 200
RECENT_OPERATIONS = 100
CHUNK_BYTES = 1024 * 1024

# Limits that choose between two exact ways of doing the same thing.
HOT_ROWS = 1_000_000        # a group above this many rows is split over tasks
BROADCAST_ROWS = 1_000_000  # a key list above this many rows is shuffled, not broadcast
PART_ROWS = 1_000_000       # rows sorted in one task, unless the session shuffles into more parts
READ_BYTES = 1 << 30        # bytes of files read by one task, unless there are fewer tasks than cores
BLOOM_BLOCKS = 1 << 20      # blocks of 8 bytes in a Bloom filter at most


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.stowline.hotRows", str(HOT_ROWS)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.stowline.broadcastRows", str(BROADCAST_ROWS)))


def bloom_blocks(spark: SparkSession) -> int:
    """A power of two."""
    asked = int(spark.conf.get("spark.stowline.bloomBlocks", str(BLOOM_BLOCKS)))
    return 1 << (max(1, asked).bit_length() - 1)


def reading_tasks(spark: SparkSession) -> int:
    """Tasks for work whose cost does not show in bytes: opening files, listing folders."""
    return max(4 * spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))
