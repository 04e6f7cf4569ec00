"""SQL for DuckDB whose rows each query must equal.

Written from the definitions, not from the Spark code: scan order compares
lists of path components, the digest rules are plain joins, and name conflicts
of interacting names are played through one request at a time.
"""

from __future__ import annotations

from stowline.settings import CATEGORIES, EXTENSIONS, IGNORED_NAMES
from workload import fixtures as fx

_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_EXT_ROWS = ", ".join(f"('{e}', '{c}')" for c, known in EXTENSIONS.items() for e in known)
_EXT = r"lower(regexp_extract({0}, '(?s)^.+\.([^.]+)$', 1))"
_SUFFIX = r"regexp_extract({0}, '(?s)^.+(\.[^.]+)$', 1)"
_NAME = "string_split({0}, '/')[-1]"
_PARTS = "string_split({0}, '/')"
_GONE = "'Source file does not exist (deleted meanwhile).'"


def _slot_name(name: str, slot: str) -> str:
    suffix = _SUFFIX.format(name)
    return (f"case when {slot} = 0 then {name} else concat(left({name}, length({name}) - "
            f"length({suffix})), ' (', {slot}, ')', {suffix}) end")


def _scope(ignored: list[str] | None, hidden: bool, direct: bool = False) -> str:
    tests = []
    if ignored is not None:
        tests.append(f"not list_has_any({_PARTS.format('rel_path')}, {_list(ignored)})")
    if hidden:
        tests.append(f"len(list_filter({_PARTS.format('rel_path')}, lambda x: x[1] = '.')) = 0")
    if direct:
        tests.append(f"len({_PARTS.format('rel_path')}) = 1")
    return f"select * from inventory where {' and '.join(tests)}"


def _plan(table: str, organized: bool = True, protected: list[str] = ()) -> str:
    tests = [f"not list_contains({_PARTS.format('path')}, 'Duplicate_Review')"]
    if organized:
        tests.append(f"not list_has_any({_PARTS.format('path')}, {_list(CATEGORIES)})")
    tests += [f"strpos(lower(path), '{p.lower()}') = 0" for p in protected]
    return f"""select * from (
      select path as source_path,
        concat('/lake/', coalesce(e.category, 'Other'), '/', {_NAME.format('path')}) as destination_path,
        coalesce(e.category, 'Other') as category, rel_path
      from {table} f left join ext e on e.extension = {_EXT.format(_NAME.format('path'))}
      where {' and '.join(tests)}) p where source_path <> destination_path"""


def _named(requests: str, taken: str) -> str:
    """Requests (directory, name, ord, ...) with the lowest free slots; for names that
    are not each other's numbered forms. ``taken`` has (directory, name)."""
    return f"""
      select q.* exclude (r), {_slot_name('q.name', '(r + coalesce(below, 0))')} as final_name
      from (select *, row_number() over (partition by directory, name order by ord) - 1 as r
            from {requests}) q
      left join (
        select r.directory, r.name, r.ord, count(*) as below
        from (select directory, name, ord,
                row_number() over (partition by directory, name order by ord) - 1 as r from {requests}) r
        join (select directory, name, slot - row_number() over (
                partition by directory, name order by slot) + 1 as free
              from (select distinct s.directory, s.name, s.slot from (
                  select a.directory, a.name,
                    case when t.name = a.name then 0 else try_cast(regexp_extract(
                      substr(t.name, length(a.name) - length({_SUFFIX.format('a.name')}) + 1),
                      '^ \\(([1-9][0-9]*)\\)', 1) as bigint) end as slot, t.name as existing
                  from (select distinct directory, name from {requests}) a
                  join {taken} t on t.directory = a.directory
                    and (t.name = a.name or starts_with(t.name, concat(left(a.name,
                      length(a.name) - length({_SUFFIX.format('a.name')})), ' (')))) s
                where s.slot is not null and s.existing = {_slot_name('s.name', 's.slot')})) e
          on e.directory = r.directory and e.name = r.name and e.free <= r.r
        group by all) b
      on b.directory = q.directory and b.name = q.name and b.ord = q.ord"""


# Named steps; each query lists the ones it needs, in order.
_STEPS = {
    "inventory": fx.duck(fx.INVENTORY, documents="documents"),
    "occupied": fx.duck(fx.OCCUPIED, labels="labels"),
    "lake_now": fx.duck(fx.LAKE_NOW, inventory="inventory", labels="labels", occupied="occupied"),
    "ops": fx.duck(fx.OPERATIONS, events="events"),
    "undo_state": fx.duck(fx.UNDO_STATE, operations="ops"),
    "ext": f"select * from (values {_EXT_ROWS}) t(extension, category)",
    "scoped": _scope(IGNORED_NAMES, True),
    # Duplicates
    "members": f"""
      select digest, path, rel_path, size,
        row_number() over (partition by digest order by {_PARTS.format('rel_path')}) as member_no,
        count(*) over (partition by digest) as n_files
      from (select *, sha256(content) as digest from scoped
            where size in (select size from scoped group by size having count(*) > 1)) h
      qualify n_files > 1""",
    "groups": f"""
      select digest, size, n_files, (n_files - 1) * size as recoverable,
        row_number() over (order by size desc, {_PARTS.format('rel_path')}) as group_no
      from members where member_no = 1""",
    "decisions": fx.duck(fx.DECISIONS, groups="groups"),
    "answers": """
      select d.digest, d.choice, g.n_files,
        case when lower(trim(d.choice)) = 's' then 's'
             when try_cast(trim(d.choice) as bigint) between 1 and g.n_files
               then cast(try_cast(trim(d.choice) as bigint) as varchar) end as answer
      from decisions d join groups g on g.digest = d.digest""",
    "keepers": """
      select g.digest, g.group_no, try_cast(a.answer as bigint) as keep_no
      from groups g left join answers a on a.digest = g.digest""",
    "review_asks": f"""
      select m.digest, m.member_no, m.path as source_path,
        concat('/lake/Duplicate_Review/', {_NAME.format('m.path')}) as destination_path,
        '/lake/Duplicate_Review' as directory, {_NAME.format('m.path')} as name,
        k.group_no * 1000000000 + m.member_no as ord
      from members m join keepers k on k.digest = m.digest
      where k.keep_no <> m.member_no and m.path in (select path from lake_now)""",
    "lake_names": f"""
      select left(path, length(path) - length({_NAME.format('path')}) - 1) as directory,
        {_NAME.format('path')} as name from lake_now""",
    "reviewed": _named("review_asks", "lake_names"),
    # Organising
    "planned": _plan("scoped"),
    "asks": f"""
      select *, concat('/lake/', category) as directory, {_NAME.format('source_path')} as name,
        {_PARTS.format('rel_path')} as ord
      from planned where source_path in (select path from lake_now)""",
    "moved": _named("asks", "lake_names"),
    "outcome": f"""
      select p.source_path, p.destination_path, p.category, p.rel_path,
        m.directory || '/' || m.final_name as final_path,
        case when m.source_path is null then 'FAILED' else 'SUCCESS' end as status,
        case when m.source_path is null then {_GONE} end as error_message
      from planned p left join moved m on m.source_path = p.source_path""",
    # Undo
    "latest": """select batch_id from ops where status = 'SUCCESS' order by id desc limit 1""",
    "reverse": """
      select row_number() over (order by id desc) as undo_seq,
        destination_path as current_path, source_path as original_path
      from ops where batch_id = (select batch_id from latest) and status = 'SUCCESS'
        and operation_type in ('ORGANIZE', 'DUPLICATE_REVIEW') and source_path <> destination_path""",
    "undo_asks": f"""
      select undo_seq, current_path, original_path, undo_seq as ord,
        {_NAME.format('original_path')} as name,
        left(original_path, length(original_path) - length({_NAME.format('original_path')}) - 1) as directory
      from reverse where current_path in (select path from undo_state)
      qualify row_number() over (partition by current_path order by undo_seq) = 1""",
    "undo_names": f"""
      select left(path, length(path) - length({_NAME.format('path')}) - 1) as directory,
        {_NAME.format('path')} as name from undo_state""",
    "restored": _named("undo_asks", "undo_names"),
    "undone": """
      select 'UNDO' as operation_type, r.current_path as source_path,
        case when n.undo_seq is null then r.original_path
             else concat(n.directory, '/', n.final_name) end as destination_path,
        case when n.undo_seq is null then 'FAILED' else 'SUCCESS' end as status,
        case when n.undo_seq is null then 'File missing' end as error_message, r.undo_seq
      from reverse r left join restored n on n.undo_seq = r.undo_seq""",
}

_DUP = "inventory scoped members groups"
_REVIEW = f"{_DUP} occupied lake_now lake_names decisions answers keepers review_asks reviewed"
_PLAN = "inventory ext scoped planned"
_MOVE = f"{_PLAN} occupied lake_now lake_names asks moved outcome"
_UNDO = "ops undo_state latest reverse undo_asks undo_names restored undone"


def _sql(steps: str, final: str, recursive: bool = False) -> str:
    used = [f"{name} as ({_STEPS[name]})" for name in steps.split()]
    word = "with recursive" if recursive else "with"
    return f"{word} {', '.join(used)}\n{final}" if used else final


def _human(bytes_: str) -> str:
    value = f"greatest({bytes_}, 0)"
    units = " ".join(
        f"when {value} < {1024 ** (p + 1)} then printf('%.1f {u}', {value} / {float(1024 ** p)})"
        for p, u in [(1, "KB"), (2, "MB"), (3, "GB")])
    return (f"case when {value} < 1024 then concat({value}, ' B') {units} "
            f"else printf('%.1f TB', {value} / {float(1024 ** 4)}) end")


def _metadata(path: str) -> str:
    name = _NAME.format(path)
    return f"{name} as name, {_EXT.format(name)} as extension"


def _after(moves: str, more: str) -> str:
    """The lake after moves (source_path, final_path)."""
    return f"""select coalesce(o.final_path, l.path) as path,
      coalesce(substr(o.final_path, 7), l.rel_path) as rel_path, l.size
      from lake_now l left join {moves} o on o.source_path = l.path {more}"""


_HISTORY = r"""select id, concat('[', case when status = 'SUCCESS' then '+' else '!' end, '] ',
  rpad(operation_type, 16, ' '), ' ', strftime(timestamp, '%Y-%m-%dT%H:%M:%S'),
  case when microsecond(timestamp) % 1000000 = 0 then '' else strftime(timestamp, '.%f') end,
  '+00:00  ', source_path, ' -> ', destination_path) as line
from ops order by id desc limit 100"""

_REPORT = f"""
select cast(group_no as bigint) as group_no, part, cast(member_no as bigint) as member_no,
  cast(line_no as bigint) as line_no, line from (
  select 0 as group_no, 0 as part, 0 as member_no, unnest([1, 2, 3]) as line_no,
    unnest(['Scanned: /lake', concat('Found ', count(*), ' duplicate group(s).'), '']) as line from groups
  union all
  select group_no, 1, 0, unnest([1, 2, 3, 4, 5]),
    unnest([concat('Duplicate group ', group_no), '', concat('Hash: ', digest), '', 'Files:']) from groups
  union all
  select g.group_no, 2, m.member_no, unnest([1, 2]), unnest([concat(m.member_no, '. ', m.path),
    concat('   Size: ', {_human('m.size')})]) from members m join groups g on g.digest = m.digest
  union all
  select group_no, 3, 0, unnest([1, 2, 3]), unnest(['', concat('Potential space that can be recovered: ',
    {_human('recoverable')}), '']) from groups) lines"""

_LISTING = f"""
with_listing as (select path, row_number() over (order by {_PARTS.format('rel_path')}) as n,
  count(*) over () as total from scoped)
select row_number() over (order by pos) as line_no, line from (
  select 1 as pos, 'Scanned directory: /lake' as line
  union all select 2, concat('Found ', count(*), ' file(s).') from scoped
  union all select 3, ''
  union all select n + 3, concat('  ', path) from with_listing where n <= 200
  union all select distinct 1000, concat('  ... and ', total - 200, ' more.') from with_listing
    where total > 200) x"""

_PREVIEW = f"""
numbered as (select *, row_number() over (order by {_PARTS.format('rel_path')}) as n,
  count(*) over () as total from planned)
select row_number() over (order by pos, sub) as line_no, line from (
  select 0 as pos, unnest([1, 2]) as sub, unnest(['Planned operations:', '']) as line
  union all select n, unnest([1, 2, 3, 4]), unnest([concat(n, '. ', {_NAME.format('source_path')}),
    concat('   From: ', source_path), concat('   To:   ', destination_path), ''])
    from numbered where n <= 50
  union all select 1000, unnest([1, 2]), unnest([concat('... and ', total - 50, ' more.'), ''])
    from (select distinct total from numbered where total > 50) t
  union all select 1001, 1, concat('Total files to move: ', count(*)) from planned) x"""

_UNDO_PREVIEW = """
select cast(undo_seq as bigint) as undo_seq, cast(line_no as bigint) as line_no, line from (
  select 0 as undo_seq, unnest([1, 2]) as line_no, unnest(['Undo preview:', '']) as line
  union all select undo_seq, unnest([1, 2, 3, 4, 5, 6]), unnest([concat(undo_seq, '. Move:'),
    concat('   ', current_path), '', '   Back to:', concat('   ', original_path), '']) from reverse
  union all select count(*) + 1, 1, concat('Total files to restore: ', count(*)) from reverse) x"""

# Each family plays its requests in turn; ``used`` holds the names taken so far.
_CASCADE = f"""
with recursive notes as ({fx.duck(fx.NOTES, documents='documents', labels='labels')}),
asks as (select *, row_number() over (partition by family order by doc_id) as turn
  from notes where not present),
game as (
  select a.family, cast(0 as bigint) as turn, cast(null as bigint) as doc_id,
    cast(null as varchar) as name, cast(null as varchar) as final_name,
    coalesce((select list(distinct n.name) from notes n where n.present and n.family = a.family),
      cast([] as varchar[])) as used
  from (select distinct family from asks) a
  union all
  select family, turn, doc_id, name, final_name, list_append(used, final_name) from (
    select g.family, a.turn, a.doc_id, a.name, g.used,
      list_filter(list_transform(range(0, len(g.used) + 1), lambda k: {_slot_name('a.name', 'k')}),
        lambda c: not list_contains(g.used, c))[1] as final_name
    from game g join asks a on a.family = g.family and a.turn = g.turn + 1) step)
select doc_id, 'notes' as directory, name, final_name from game where turn > 0"""

# The steps are played in turn; ``used`` holds the paths there are.
_CHAINS = f"""
with recursive log as ({fx.duck(fx.CHAIN_LOG, documents='(select distinct doc_id from documents) d')}),
state as ({fx.duck(fx.CHAIN_STATE, log='log')}),
steps as (select row_number() over (order by id desc) as seq, destination_path as cur, source_path as orig
  from log where status = 'SUCCESS' and source_path <> destination_path),
game as (
  select cast(0 as bigint) as seq, cast(null as varchar) as cur, cast(null as varchar) as orig,
    cast(null as varchar) as final, (select list(path) from state) as used
  union all
  select seq, cur, orig, final, case when final is null then used
    else list_append(list_filter(used, lambda p: p <> cur), final) end
  from (select s.seq, s.cur, s.orig, g.used, case when not list_contains(g.used, s.cur) then null
      when not list_contains(g.used, s.orig) then s.orig
      else list_filter(list_transform(range(1, 50), lambda k: {_slot_name('s.orig', 'k')}),
        lambda c: not list_contains(g.used, c))[1] end as final
    from game g join steps s on s.seq = g.seq + 1) step)
"""

ORACLE = {
    "undo_chains": _CHAINS + """select seq as undo_seq, 'UNDO' as operation_type, cur as source_path,
        coalesce(final, orig) as destination_path, case when final is null then 'FAILED' else 'SUCCESS' end as status,
        case when final is null then 'File missing' end as error_message from game where seq > 0""",
    "undo_chains_inventory": _CHAINS + f"""select path, {_NAME.format('path')} as name
        from (select unnest(used) as path from (select used from game order by seq desc limit 1) g) x""",
    "review_append": _sql(f"{_REVIEW} ops", """
        select * from ops union all
        select (select max(id) from ops) + row_number() over (order by ord), 'feedc0de00000001', 'DUPLICATE_REVIEW',
          source_path, concat(directory, '/', final_name), timestamp '2024-02-01 12:00:00', 'SUCCESS', null
        from reviewed"""),
    "inventory_load": """select concat('/docs/', source, '/', doc_id) as path,
        concat(source, '/', doc_id) as rel_path, n_chars as size from documents""",
    "file_metadata": _sql("inventory", f"""select path, {_metadata('path')}, size,
        (1700000000 + doc_id * 3600) * 1000000 + 500000 as modified_us from inventory"""),
    "scope_ignored": _sql("inventory", f"select rel_path from ({_scope(IGNORED_NAMES, False)})"),
    "scope_custom_ignore": _sql(
        "inventory", f"select rel_path from ({_scope([*IGNORED_NAMES, 'src3', 'fr'], False)})"),
    "scope_hidden": _sql("inventory", f"select rel_path from ({_scope(None, True)})"),
    "scope_include_hidden": _sql("inventory", f"select rel_path from ({_scope(IGNORED_NAMES, False)})"),
    "scope_non_recursive": _sql("inventory", f"select rel_path from ({_scope(IGNORED_NAMES, True, True)})"),
    "scope_default": _sql("inventory scoped", "select rel_path from scoped"),
    "scan_order": _sql("inventory scoped", f"""select rel_path,
        row_number() over (order by {_PARTS.format('rel_path')}) as ordinal from scoped"""),
    "classify": _sql("inventory ext", f"""select rel_path, x as extension,
        coalesce(category, 'Other') as category
        from (select rel_path, {_EXT.format(_NAME.format('rel_path'))} as x from inventory) f
        left join ext on ext.extension = f.x"""),
    "classify_pages": _sql("ext", f"""select page_id, name, x as extension,
        coalesce(category, 'Other') as category
        from (select *, {_EXT.format('name')} as x from ({fx.duck(fx.PAGES, pages='pages')})) f
        left join ext on ext.extension = f.x"""),
    "human_size": _sql("inventory", f"""select doc_id, bytes, {_human('bytes')} as text from (
        select distinct doc_id, unnest([-size, size, size * 1000, size * 1000000, size * 1000000000]) as bytes
        from inventory) s"""),
    "size_buckets": _sql("inventory scoped", """select size, count(*) as n_files from scoped
        group by size having count(*) > 1"""),
    "dup_candidates": _sql("inventory scoped", """select rel_path, size, sha256(content) as digest
        from scoped where size in (select size from scoped group by size having count(*) > 1)"""),
    "dup_groups": _sql(_DUP, "select digest, size, n_files, recoverable from groups"),
    "dup_recoverable": _sql("inventory", """
        select count(*) as groups, cast(sum(n) as bigint) as members,
          cast(sum((n - 1) * size) as bigint) as recoverable
        from (select sha256(content) as digest, min(size) as size, count(*) as n
              from inventory group by 1 having count(*) > 1) g"""),
    "dup_members": _sql(_DUP, "select digest, member_no, rel_path, size from members"),
    "dup_rejects": _sql("inventory", """
        select rel_path, known as size, case when known is null then 'size unknown'
          when gone then 'missing' else 'size mismatch' end as error
        from (select *, doc_id in (select doc_id from labels where toxic = 1) as gone,
                case when doc_id % 97 <> 0 then n_chars end as known from inventory) f
        where known is null or ((gone or known <> size) and known in (
          select n_chars from inventory where doc_id % 97 <> 0 group by n_chars having count(*) > 1))"""),
    "dup_group_numbers": _sql(_DUP, "select group_no, digest, size, n_files, recoverable from groups"),
    "dup_report": _sql(_DUP, _REPORT),
    "plan_moves": _sql(_PLAN, "select source_path, destination_path, category from planned"),
    "plan_already_organized": _sql(
        "inventory occupied lake_now ext",
        f"select source_path, destination_path, category from ({_plan('lake_now')})"),
    "plan_include_subfolders": _sql(
        "inventory occupied lake_now ext",
        f"select source_path, destination_path, category from ({_plan('lake_now', organized=False)})"),
    "plan_protected": _sql(
        "inventory ext scoped", "select source_path, destination_path, category from "
        f"({_plan('scoped', protected=['/lake/SRC3/', 'rc7/en'])})"),
    "plan_preview": _sql(_PLAN, _PREVIEW.lstrip()).replace(")\nnumbered as", "),\nnumbered as", 1),
    "scan_listing": _sql("inventory scoped", _LISTING.lstrip()).replace(
        ")\nwith_listing as", "),\nwith_listing as", 1),
    "resolve_names": _sql(
        f"{_PLAN} occupied", f"""
        , wanted as (select source_path, concat('/lake/', category) as directory,
            {_NAME.format('source_path')} as name, {_PARTS.format('rel_path')} as ord from planned),
        there as (select concat('/lake/', directory) as directory, name from occupied)
        select source_path, directory, name, final_name from ({_named('wanted', 'there')})"""),
    "resolve_names_cascade": _CASCADE,
    "apply_plan_status": _sql(_MOVE, """select source_path, destination_path, category, final_path,
        status, error_message from outcome"""),
    "apply_plan_inventory": _sql(_MOVE, f"""
        select path, rel_path, {_metadata('path')}, size from ({_after('outcome', "and o.status = 'SUCCESS'")}) x"""),
    "apply_plan_twice": _sql(f"{_MOVE}", f"""
        , after as ({_after('outcome', "and o.status = 'SUCCESS'")}),
        in_scope as ({_scope(IGNORED_NAMES, True).replace('from inventory', 'from after')})
        select source_path, destination_path, category from ({_plan('in_scope')})""").replace("\n\n        , after", "\n, after"),
    "review_inventory": _sql(_REVIEW, f"""
        select path, rel_path, {_metadata('path')}, size from ({_after(
            "(select source_path, concat(directory, '/', final_name) as final_path from reviewed)", '')}) x"""),
    "undo_append": _sql(f"{_UNDO}", """
        select * from ops union all
        select (select max(id) from ops) + row_number() over (order by undo_seq), 'feedc0de00000001',
          operation_type, source_path, destination_path, timestamp '2024-02-01 12:00:00', status, error_message
        from undone"""),
    "ops_append": _sql(f"{_MOVE} ops", f"""
        select * from ops union all
        select (select max(id) from ops) + row_number() over (order by {_PARTS.format('rel_path')}),
          'feedc0de00000001', 'ORGANIZE', source_path, coalesce(final_path, destination_path),
          timestamp '2024-02-01 12:00:00', status, error_message from outcome"""),
    "ops_newest_batch": _sql(f"{_MOVE} ops", f"""
        select (select max(id) from ops) + row_number() over (order by {_PARTS.format('rel_path')}) as id,
          'feedc0de00000001' as batch_id, 'ORGANIZE' as operation_type, source_path,
          coalesce(final_path, destination_path) as destination_path,
          timestamp '2024-02-01 12:00:00' as timestamp, status, error_message from outcome"""),
    "ops_normalise": _sql("ops", """select id,
        case when status = 'SUCCESS' then batch_id else 'feedc0de00000001' end as batch_id,
        operation_type, status, error_message from ops"""),
    "history_recent": _sql("ops", "select * from ops order by id desc limit 100"),
    "history_lines": _sql("ops", _HISTORY),
    "history_report": _sql("ops", f"""select line_no, line from (
        select unnest([1, 2])::bigint as line_no, unnest(['Recent operations:', '']) as line
        union all select row_number() over (order by id desc) + 2, line from ({_HISTORY}) h) x"""),
    "latest_batch": _sql("ops latest", "select batch_id from latest"),
    "latest_batch_ops": _sql("ops latest", "select * from ops where batch_id = (select batch_id from latest)"),
    "review_decisions": _sql(f"{_DUP} decisions answers", "select * from answers"),
    "review_plan": _sql(_REVIEW, """select digest, member_no, source_path, destination_path,
        concat(directory, '/', final_name) as final_path from reviewed"""),
    "review_summary": _sql(_REVIEW, """select (select count(*) from reviewed) as moved,
        (select count(*) from keepers where keep_no is null) as skipped"""),
    "review_dry_run": _sql(_DUP, "select cast(0 as bigint) as moved, count(*) as skipped from groups"),
    "undo_plan": _sql("ops latest reverse", "select * from reverse"),
    "undo_preview": _sql("ops latest reverse", _UNDO_PREVIEW),
    "undo_apply": _sql(_UNDO, "select * from undone"),
    "undo_inventory": _sql(_UNDO, f"""select path, {_metadata('path')} from (
        select coalesce(u.destination_path, s.path) as path from undo_state s
        left join undone u on u.source_path = s.path and u.status = 'SUCCESS') x"""),
    "undo_summary": _sql(_UNDO, """select count_if(status = 'SUCCESS')::bigint as restored,
        count_if(status = 'FAILED')::bigint as failed,
        count_if(status = 'FAILED') > 0 and count_if(status = 'SUCCESS') = 0 as all_failed from undone"""),
    "summary_counts": _sql(f"{_MOVE} members groups", """
        select 'files_scanned' as metric, count(*) as value from scoped
        union all select 'groups_found', count(*) from groups
        union all select 'moves_planned', count(*) from planned
        union all select 'files_moved', count(*) from outcome where status = 'SUCCESS'"""),
}
ORACLE["resolve_names"] = ORACLE["resolve_names"].replace("\n\n        , wanted", "\n, wanted")
for _name in ("sha256", "sha1", "md5"):
    ORACLE[f"digest_{_name}"] = _sql("inventory", f"select doc_id, {_name}(content) as digest from inventory")
