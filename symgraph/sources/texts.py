"""Source texts over the sales tables: a Python or TypeScript file for each customer, a SQL file for each supplier.

Each holds what misleads a reader of lines: calls in comments and texts, nested blocks, statements over several
lines, and calls outside of any definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .star import table

PYTHON = '''"""Customer {k}: said_{k}() is only said here.

def hidden(): pass
"""
import os
class S{k}(Base{n}):
    def first(self):
        text = "call_{k}()"  # other_{k}()
        return target_{n}(self.again({k}))
    value = top_{k}(
        1)
def top_{k}(
    a,
):
    def inner():
        os.getcwd()
        return S{k}("select id from table_{n} t "
                    "join app.part_{n} p on p.id = t.id")

    return inner
if __name__ == "__main__":
    top_{k}(2)
'''
TYPESCRIPT = '''import {
  base,
} from './base';
/* hidden_{k}()
   more_{k}() */
export class C{k} extends Base{n} {
  private limit = seed_{k}(1);
  open(a: string) {
    return target_{n}(`text_{k}() {`, "{");
  }
}
export const run_{k} = (a) => {
  const c = new C{k}();
  return c.open('x()');
};
run_{k}(1);
'''
SQL_FILE = '''-- create table no_{k} (x int);
create table if not exists app."Items_{k}" (
  id int primary key,
  note text default 'create table ghost_{k} (x int); references x',
  owner int references owner_{n} (id)
);
alter table items_{k} add foreign key (part) references app.parts_{n};
create or replace view seen_{k} as
  select * from items_{k} i join owner_{n} o on o.id = i.owner;
create unique index at_{k} on items_{k} (id); create function f_{k}() returns int as $$ select 1; $$ language sql;
'''


PYTHON_WEB = '''"""Serves supplier {k}."""
# not this one

@app.route("/s{k}/<id>", methods=["get", "put"])
@checked
def show_{k}(
    id,
):
    """Shows supplier {k}.

    At length.
    """
    return id
@app.post("/s{k}")
async def make_{k}(): return 1
'''
JAVA_WEB = '''package n{n};
/**
 * Serves supplier {k}.
 * @since 1
 */
@RestController
@RequestMapping("/api/n{n}")
public class C{k} {
  // Gets {k}.
  @GetMapping("/{id}")
  public String get(int id) { return "@PostMapping(\\"/no\\")"; }

  @RequestMapping(path = "s{k}", method = RequestMethod.PUT)
  String put(
      int a) { return ""; }
}
'''


def _filled(text: str, k: Column, n: Column) -> Column:
    return F.replace(F.replace(F.lit(text), F.lit("{k}"), k.cast("string")), F.lit("{n}"), n.cast("string"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, lang and text."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    python = F.col("k") % 2 == 0
    text = F.when(python, _filled(PYTHON, F.col("k"), F.col("n"))).otherwise(_filled(TYPESCRIPT, F.col("k"), F.col("n")))
    path = F.concat(F.lit("n"), F.col("n").cast("string"), F.lit("/c"), F.col("k").cast("string"), F.when(python, ".py").otherwise(".ts"))
    own = customer.select(path.alias("path"), F.when(python, "python").otherwise("typescript").alias("lang"), text.alias("text"))
    sql = supplier.select(F.concat(F.lit("db/s"), F.col("k").cast("string"), F.lit(".sql")).alias("path"), F.lit("sql").alias("lang"), _filled(SQL_FILE, F.col("k"), F.col("n")).alias("text"))
    return own.unionByName(sql)


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, lang and text of handlers of routes: a Python or Java file for each supplier."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    python = F.col("k") % 2 == 0
    path = F.concat(F.lit("web/s"), F.col("k").cast("string"), F.when(python, ".py").otherwise(".java"))
    text = F.when(python, _filled(PYTHON_WEB, F.col("k"), F.col("n"))).otherwise(_filled(JAVA_WEB, F.col("k"), F.col("n")))
    return supplier.select(path.alias("path"), F.when(python, "python").otherwise("java").alias("lang"), text.alias("text"))


#: What is said about the handlers: kind, names, signature, doc, visibility, and the handler of an endpoint.
WEB_SQL = """
WITH s AS (
  SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 2 = 0 AS py, 'web/s' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.java' END AS path FROM supplier
), about AS (
  SELECT path, path || ':module' AS id, NULL AS signature, CASE WHEN py THEN 'Serves supplier ' || k || '.' END AS doc, true AS exported, NULL AS handler FROM s
  UNION ALL SELECT path, path || ':function:show_' || k, 'def show_' || k || '( id, )', 'Shows supplier ' || k || '.', true, NULL FROM s WHERE py
  UNION ALL SELECT path, path || ':function:make_' || k, 'async def make_' || k || '()', NULL, true, NULL FROM s WHERE py
  UNION ALL SELECT path, path || ':endpoint:GET|PUT /s' || k || '/<id>', 'GET|PUT /s' || k || '/<id>', 'Shows supplier ' || k || '.', true, path || ':function:show_' || k FROM s WHERE py
  UNION ALL SELECT path, path || ':endpoint:POST /s' || k, 'POST /s' || k, NULL, true, path || ':function:make_' || k FROM s WHERE py
  UNION ALL SELECT path, path || ':class:C' || k, 'public class C' || k, 'Serves supplier ' || k || '.', true, NULL FROM s WHERE NOT py
  UNION ALL SELECT path, path || ':method:C' || k || '.get', 'public String get(int id)', 'Gets ' || k || '.', true, NULL FROM s WHERE NOT py
  UNION ALL SELECT path, path || ':method:C' || k || '.put', 'String put( int a)', NULL, false, NULL FROM s WHERE NOT py
  UNION ALL SELECT path, path || ':endpoint:GET /api/n' || n || '/{id}', 'GET /api/n' || n || '/{id}', 'Gets ' || k || '.', true, path || ':method:C' || k || '.get' FROM s WHERE NOT py
  UNION ALL SELECT path, path || ':endpoint:PUT /api/n' || n || '/s' || k, 'PUT /api/n' || n || '/s' || k, NULL, true, path || ':method:C' || k || '.put' FROM s WHERE NOT py
)
"""
#: What the texts define and refer to, as the generator knows it.
SQL = """
WITH f AS (
  SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 2 = 0 AS py, 'n' || c_nationkey || '/c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.py' ELSE '.ts' END AS path FROM customer
), s AS (
  SELECT s_suppkey AS k, s_nationkey AS n, 'db/s' || s_suppkey || '.sql' AS path FROM supplier
), defs AS (
  SELECT path, 'class' AS kind, 'S' || k AS qualified, 6 AS line_start, 11 AS line_end FROM f WHERE py
  UNION ALL SELECT path, 'method', 'S' || k || '.first', 7, 9 FROM f WHERE py
  UNION ALL SELECT path, 'function', 'top_' || k, 12, 20 FROM f WHERE py
  UNION ALL SELECT path, 'function', 'top_' || k || '.inner', 15, 18 FROM f WHERE py
  UNION ALL SELECT path, 'class', 'C' || k, 6, 11 FROM f WHERE NOT py
  UNION ALL SELECT path, 'method', 'C' || k || '.open', 8, 10 FROM f WHERE NOT py
  UNION ALL SELECT path, 'function', 'run_' || k, 12, 15 FROM f WHERE NOT py
  UNION ALL SELECT path, 'table', 'items_' || k, 2, 6 FROM s
  UNION ALL SELECT path, 'table', 'seen_' || k, 8, 9 FROM s
  UNION ALL SELECT path, 'function', 'f_' || k, 10, 10 FROM s
), refs AS (
  SELECT path, 'inherits' AS type, ':class:S' || k AS owner, 'Base' || n AS name, NULL AS qualifier, 6 AS line FROM f WHERE py
  UNION ALL SELECT path, 'calls', ':method:S' || k || '.first', 'target_' || n, NULL, 9 FROM f WHERE py
  UNION ALL SELECT path, 'calls', ':method:S' || k || '.first', 'again', 'self', 9 FROM f WHERE py
  UNION ALL SELECT path, 'calls', ':class:S' || k, 'top_' || k, NULL, 10 FROM f WHERE py
  UNION ALL SELECT path, 'calls', ':function:top_' || k || '.inner', 'getcwd', 'os', 16 FROM f WHERE py
  UNION ALL SELECT path, 'calls', ':function:top_' || k || '.inner', 'S' || k, NULL, 17 FROM f WHERE py
  UNION ALL SELECT path, 'queries', ':function:top_' || k || '.inner', 'table_' || n, NULL, 17 FROM f WHERE py
  UNION ALL SELECT path, 'queries', ':function:top_' || k || '.inner', 'part_' || n, NULL, 17 FROM f WHERE py
  UNION ALL SELECT path, 'calls', ':module', 'top_' || k, NULL, 22 FROM f WHERE py
  UNION ALL SELECT path, 'inherits', ':class:C' || k, 'Base' || n, NULL, 6 FROM f WHERE NOT py
  UNION ALL SELECT path, 'calls', ':class:C' || k, 'seed_' || k, NULL, 7 FROM f WHERE NOT py
  UNION ALL SELECT path, 'calls', ':method:C' || k || '.open', 'target_' || n, NULL, 9 FROM f WHERE NOT py
  UNION ALL SELECT path, 'calls', ':function:run_' || k, 'C' || k, NULL, 13 FROM f WHERE NOT py
  UNION ALL SELECT path, 'calls', ':function:run_' || k, 'open', 'c', 14 FROM f WHERE NOT py
  UNION ALL SELECT path, 'calls', ':module', 'run_' || k, NULL, 16 FROM f WHERE NOT py
  UNION ALL SELECT path, 'references', ':table:items_' || k, 'owner_' || n, NULL, 5 FROM s
  UNION ALL SELECT path, 'references', ':table:items_' || k, 'parts_' || n, NULL, 7 FROM s
  UNION ALL SELECT path, 'queries', ':table:seen_' || k, 'items_' || k, NULL, 8 FROM s
  UNION ALL SELECT path, 'queries', ':table:seen_' || k, 'owner_' || n, NULL, 8 FROM s
  UNION ALL SELECT path, 'references', ':module', 'items_' || k, NULL, 10 FROM s
)
"""
