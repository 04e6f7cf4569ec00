"""File inventories, logs and decisions derived from the given tables.

One SQL text per table serves both engines; ``$words`` stand for the few
spellings that differ and ``{tables}`` for the inputs.
"""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame, SparkSession

SPARK_WORDS = {"S": "string", "BYTES": "cast(octet_length(text) as bigint)",
               "PATH_OF_URL": "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)",
               "DAY": "date_format(ts, 'yyyyMMdd')", "L": "bigint"}
DUCK_WORDS = {"S": "varchar", "BYTES": "strlen(text)",
              "PATH_OF_URL": "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)",
              "DAY": "strftime(ts, '%Y%m%d')", "L": "bigint"}

# Every document is a file. Paths cover hidden and ignored folders, files at the
# root, names shared by many folders, names that carry a counter, and upper-case,
# compound, absent and unknown extensions.
INVENTORY = """
select doc_id, concat('/lake/', rel_path) as path, rel_path, $BYTES as size, n_chars,
  1700000000 + doc_id * 3600 + 0.5 as modified_s, text as content
from (select doc_id, text, n_chars,
  concat(case when doc_id % 31 = 0 then '.cache/' when doc_id % 37 = 0 then 'node_modules/'
              when doc_id % 41 = 0 then 'Images/'
              when doc_id % 47 = 0 then 'Duplicate_Review/' else '' end,
    case when source = 'src0' then '' else concat(source, '/', lang, '/d',
      cast(cast(floor(doc_id / 20) as $L) as $S), '/') end,
    case when doc_id % 43 = 0 then '.' else '' end,
    case when source = 'src0' then concat('top', cast(doc_id as $S))
         else concat('f', cast(doc_id % 20 as $S)) end,
    case doc_id % 10 when 0 then '.jpg' when 1 then '.PDF' when 2 then '.mp4'
      when 3 then '.tar.gz' when 4 then '.py' when 5 then '' when 6 then '.xyz'
      when 7 then '.csv' when 8 then ' (1).txt' else '.txt' end) as rel_path
  from {documents}) named"""

# Names that exist in category folders before a move, with gaps in the counters.
OCCUPIED = """
select case doc_id % 10 when 0 then 'Images' when 1 then 'Documents' when 2 then 'Videos'
    when 3 then 'Archives' when 4 then 'Code' when 7 then 'Spreadsheets'
    when 8 then 'Documents' when 9 then 'Documents' else 'Other' end as directory,
  concat('f', cast(doc_id % 20 as $S),
    case doc_id % 10 when 3 then '.tar' when 8 then ' (1)' else '' end,
    case when doc_id < 20 then ''
         else concat(' (', cast(cast(floor(doc_id / 20) as $L) as $S), ')') end,
    case doc_id % 10 when 0 then '.jpg' when 1 then '.PDF' when 2 then '.mp4'
      when 3 then '.gz' when 4 then '.py' when 5 then '' when 6 then '.xyz'
      when 7 then '.csv' else '.txt' end) as name
from (select distinct doc_id from {labels} where quality = 1) kept"""

# The lake when a plan is carried out: files labelled toxic have gone meanwhile.
LAKE_NOW = """
select i.path, i.rel_path, i.size from {inventory} i
where not exists (select 1 from {labels} l where l.toxic = 1 and l.doc_id = i.doc_id)
union all
select concat('/lake/', directory, '/', name), concat(directory, '/', name), cast(0 as $L)
from {occupied}"""

# One batch per day; the last day is an ORGANIZE batch.
OPERATIONS = """
select event_id as id, concat('b', $DAY) as batch_id,
  case cast(substr($DAY, 7, 2) as int) % 3 when 0 then 'ORGANIZE'
    when 1 then 'DUPLICATE_REVIEW' else 'UNDO' end as operation_type,
  concat('/lake/in/u', cast(user_id as $S), '/', event_type, '.txt') as source_path,
  concat('/lake/Documents/', event_type, '-', cast(cast(round(value * 100) as $L) as $S), '.txt')
    as destination_path,
  ts as timestamp,
  case when event_type = 'error' then 'FAILED' else 'SUCCESS' end as status,
  case when event_type = 'error' then 'Source file does not exist (deleted meanwhile).' end
    as error_message
from {events}"""

# Paths present when undo runs: cheap ones are missing, signups' originals are taken again.
UNDO_STATE = """
select destination_path as path from {operations} where status = 'SUCCESS'
  and destination_path not like '/lake/Documents/%-%1.txt'
union
select source_path from {operations} where source_path like '%/signup.txt'"""

# A batch that moved files from step to step: one chain through all documents, and
# one through each seven of them; a few steps failed.
CHAIN_LOG = """
select 2 * doc_id + part as id, 'chains' as batch_id, 'ORGANIZE' as operation_type,
  case part when 0 then concat('/lake/a/', cast(doc_id as $S), '.txt')
    else concat('/lake/b', cast(cast(floor(doc_id / 7) as $L) as $S), '/', cast(doc_id % 7 as $S)) end as source_path,
  case part when 0 then concat('/lake/a/', cast(doc_id + 1 as $S), '.txt')
    else concat('/lake/b', cast(cast(floor(doc_id / 7) as $L) as $S), '/', cast(doc_id % 7 + 1 as $S)) end as destination_path,
  case when part = 1 and doc_id % 29 = 0 then 'FAILED' else 'SUCCESS' end as status
from {documents}, (select 0 as part union all select 1) parts"""

# When it is undone, some steps' places are taken again and some chains' files are gone.
CHAIN_STATE = """
select max(destination_path) as path from {log} l
where id = (select max(id) from {log} where substr(source_path, 1, 7) = '/lake/a')
union
select destination_path from {log} where destination_path like '/lake/b%/7' and id % 5 <> 0
union
select source_path from {log} where id % 23 = 1
union
select concat(source_path, ' (1)') from {log} where id % 69 = 1"""

DECISIONS = """
select digest, case when substr(digest, 1, 1) in ('0','1','2','3','4','5') then '1'
  when substr(digest, 1, 1) in ('8','9','a','b') then ' 2 '
  when substr(digest, 1, 1) in ('c','d') then 'S' else '9x' end as choice
from {groups} where substr(digest, 1, 1) not in ('6','7')"""

PAGES = """
select page_id, regexp_extract($PATH_OF_URL, '([^/]*)$$', 1) as name from {pages}"""

# Requests for names that are each other's numbered forms, one per document that
# is not labelled toxic; the toxic ones' names exist already.
NOTES = """
select d.doc_id, d.source as family, 'notes' as directory,
  concat(d.source,
    case when d.n_chars < 1000 then ''
      else concat(' (', cast(cast(floor(d.n_chars / 1000) as $L) as $S), ')') end,
    case d.n_chars % 3 when 0 then '' else concat(' (', cast(d.n_chars % 3 as $S), ')') end,
    '.txt') as name,
  coalesce(l.toxic, 0) = 1 as present
from {documents} d left join (select doc_id, max(toxic) as toxic from {labels} group by doc_id) l
  on l.doc_id = d.doc_id"""


def duck(text: str, **tables: str) -> str:
    return Template(text).substitute(DUCK_WORDS).format(**tables)


class Lake:
    """The derived tables of one scale, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(Template(text).substitute(SPARK_WORDS), **tables)

    def inventory(self) -> DataFrame:
        return self._sql(INVENTORY, documents=self.table("documents"))

    def occupied(self) -> DataFrame:
        return self._sql(OCCUPIED, labels=self.table("labels"))

    def lake_now(self) -> DataFrame:
        return self._sql(LAKE_NOW, inventory=self.inventory(), labels=self.table("labels"),
                         occupied=self.occupied())

    def operations(self) -> DataFrame:
        return self._sql(OPERATIONS, events=self.table("events"))

    def undo_state(self) -> DataFrame:
        return self._sql(UNDO_STATE, operations=self.operations())

    def chain_log(self) -> DataFrame:
        return self._sql(CHAIN_LOG, documents=self.table("documents").select("doc_id").distinct())

    def chain_state(self) -> DataFrame:
        return self._sql(CHAIN_STATE, log=self.chain_log())

    def decisions(self, groups: DataFrame) -> DataFrame:
        return self._sql(DECISIONS, groups=groups)

    def pages(self) -> DataFrame:
        return self._sql(PAGES, pages=self.table("pages"))

    def notes(self) -> DataFrame:
        return self._sql(NOTES, documents=self.table("documents"), labels=self.table("labels"))
