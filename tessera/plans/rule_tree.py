"""A tree of one class a part, each with a line from a list, so that every rule of the packs meets a line of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commands
from ..operators.cut import kept, spread
from ..session import table
from ..sources import code
from .registry import query

PART = """package lines.p{b};

public class Line{k} {
    void run(int n) {
        for (int i = 0; i < n; i++) {
            {line}
        }
    }
    void call(int n, Line{next} next) {
        while (n > 0) {
            next.step(n);
        }
    }
    void step(int n) {
        hop(n);
    }
    void hop(int n) {
        {line}
    }
}
"""
# fmt: off
#: A line, and the rules that it breaks: those of loops, of classes, of security, of migration to 17 and of compatibility with 17.
LINES = [
    ('check(Files.readAllLines(path));', 'IO', '', '', '', ''),
    ('use(new ArrayList<>());', 'ALLOCATION', '', '', '', ''),
    ('check(all.stream().anyMatch(x -> x.ok()));', 'NESTED STREAM_CREATE', '', '', '', ''),
    ('total += step;', 'STRING_CONCAT', '', '', '', ''),
    ('say(String.format("%d", n));', 'STRING_FORMAT', '', '', '', ''),
    ('use(new SimpleDateFormat("yyyy"));', 'DATE_FORMAT', '', '', 'DATE_LEGACY', ''),
    ('use(Pattern.compile("a+"));', 'REGEX_COMPILE', '', '', '', ''),
    ('use(Class.forName(name));', 'REFLECTION', '', '', '', ''),
    ('use(all.parallelStream());', 'STREAM_CREATE', '', '', '', ''),
    ('all.remove(n);', 'LIST_REMOVE', '', '', '', ''),
    ('db.executeQuery(sql);', 'DB_QUERY', '', '', '', ''),
    ('use(Integer.valueOf(n));', 'BOXING', '', '', '', ''),
    ('use(new Vector<String>());', 'VECTOR_HASHTABLE', 'VECTOR_HASHTABLE', '', 'VECTOR_USAGE', ''),
    ('model.fireTableDataChanged();', 'TABLE_FIRE', '', '', '', ''),
    ('use(context.lookup(name));', 'JNDI_LOOKUP', '', 'JNDI_INJECTION', '', ''),
    ('db.run("SELECT * FROM t");', 'SELECT_STAR', '', '', '', ''),
    ('db.run("DELETE FROM t WHERE a = " + n);', 'SQL_CONCAT', 'SQL_CONCAT', 'SQL_INJECTION', '', ''),
    ('use(pool.getConnection());', 'CONNECTION', '', '', '', ''),
    ('use(new StringBuffer());', '', 'STRINGBUFFER_SINGLE', '', 'STRINGBUFFER_USAGE', ''),
    ('use(new File(request.getName()));', 'IO', '', 'PATH_TRAVERSAL', '', ''),
    ('use(DocumentBuilderFactory.newInstance());', 'REFLECTION', '', 'XXE', '', ''),
    ('use(in.readObject());', '', '', 'INSECURE_DESERIALIZATION', '', ''),
    ('use(getInstance("MD5"));', '', '', 'WEAK_CRYPTO', '', ''),
    ('apiKey = "abc";', '', '', 'HARDCODED_SECRET', '', ''),
    ('use(new Random());', '', '', 'INSECURE_RANDOM', '', ''),
    ('reply.sendRedirect(request.url);', '', '', 'OPEN_REDIRECT', '', ''),
    ('use(dir.search("(uid=" + n));', '', '', 'LDAP_INJECTION', '', ''),
    ('use(new HashMap<String, List<Integer>>());', 'ALLOCATION', '', '', 'DIAMOND_OPERATOR', ''),
    ('use(new Hashtable<String, String>());', 'VECTOR_HASHTABLE', 'VECTOR_HASHTABLE', '', 'HASHTABLE_USAGE', ''),
    ('use(new URL("http://a"));', 'CONNECTION', '', '', '', ''),
    ('use(javax.servlet.Filter.class);', '', '', '', 'JAVAX_SERVLET', ''),
    ('use(Collections.unmodifiableList(all));', '', '', '', 'COLLECTIONS_UNMODIFIABLE', ''),
    ('use(Collections.emptyList());', '', '', '', 'COLLECTIONS_EMPTY', ''),
    ('use(Collections.synchronizedMap(all));', '', '', '', 'SYNCHRONIZED_MAP', ''),
    ('use(Collections.synchronizedList(all));', '', '', '', 'SYNCHRONIZED_LIST', ''),
    ('use(Collections.synchronizedSet(all));', '', '', '', 'SYNCHRONIZED_SET', ''),
    ('sort(all, (a, b) -> a - b);', '', '', '', 'LAMBDA_VAR', ''),
    ('say("a" + "\\n" + n);', '', '', '', 'TEXT_BLOCK', ''),
    ('use(HttpURLConnection.class);', '', '', '', 'HTTP_CLIENT', ''),
    ('use(engine("nashorn"));', '', '', '', 'NASHORN_ENGINE', ''),
    ('use(new SecurityManager());', '', '', '', 'SECURITY_MANAGER', ''),
    ('worker.stop();', '', '', '', 'THREAD_STOP', ''),
    ('use(m.containsKey(k) ? m.get(k) : n);', '', '', '', 'MAP_GET_OR_DEFAULT', ''),
    ('use(o.isPresent() ? o.get() : n);', '', '', '', 'OPTIONAL_OR_ELSE', ''),
    ('say(text.trim());', '', '', '', 'STRING_STRIP', ''),
    ('use(s.collect(Collectors.toList()));', '', '', '', 'STREAM_TO_LIST', ''),
    ('if (o instanceof Line) { use(o); }', '', '', '', 'INSTANCEOF_CAST', ''),
    ('use(javax.xml.bind.JAXB.class);', '', '', '', '', 'JAXB'),
    ('use(javax.xml.ws.Service.class);', '', '', '', '', 'JAX_WS'),
    ('use(javax.activation.DataSource.class);', '', '', '', '', 'ACTIVATION'),
    ('use(org.omg.CORBA.ORB.class);', '', '', '', '', 'CORBA'),
    ('use(new ScriptEngineManager());', '', '', '', '', 'NASHORN'),
    ('use(javax.annotation.Resource.class);', '', '', '', '', 'JAVA_EE_MODULES'),
    ('use(java.security.acl.Acl.class);', '', '', '', '', 'SECURITY_ACL'),
    ('field.setAccessible(true);', '', '', '', '', 'ILLEGAL_ACCESS'),
    ('use(java.rmi.activation.Activator.class);', '', '', '', '', 'RMI_ACTIVATION'),
    ('use(java.applet.Applet.class);', '', '', '', 'APPLET_REMOVED', 'APPLET'),
    ('use(sun.misc.Unsafe.class);', '', '', '', '', 'SUN_MISC'),
    ('use(com.sun.tools.Tool.class);', '', '', '', '', 'COM_SUN_INTERNAL'),
    ('use(new Date());', '', '', '', 'DATE_LEGACY', ''),
    ('List<String> names = load(n);', '', '', '', 'LOCAL_VAR_TYPE', ''),
    ('use(javax.persistence.Entity.class);', '', '', '', 'JAVAX_PERSISTENCE', ''),
    ('use(javax.ejb.Stateless.class);', '', '', '', 'JAVAX_EJB', ''),
    ('use(javax.inject.Named.class);', '', '', '', 'JAVAX_INJECT', ''),
    ('use(javax.ws.rs.Path.class);', '', '', '', 'JAVAX_WS', ''),
    ('use(javax.validation.Valid.class);', '', '', '', 'JAVAX_VALIDATION', ''),
    ('say("plain");', '', '', '', '', ''),
    ('// password = "x"', '', '', '', '', ''),
    ('use(javax.annotation.processing.Filer.class);', '', '', '', '', ''),
    ('use(com.sun.jna.Native.class);', '', '', '', '', ''),
]
# fmt: on


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content_hash, mtime_ms and content of a file a part."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    total = parts.agg(F.count("*")).scalar()
    parts = spread(parts, "k")
    line = F.element_at(F.array(*(F.lit(x[0]) for x in LINES)), (F.col("k") % len(LINES) + 1).cast("int"))
    text = F.lit(PART)
    for name, value in {"b": F.col("k") % 5, "k": F.col("k"), "next": (F.col("k") + 1) % total, "line": line}.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    path = F.concat(F.lit("src/lines/Line"), "k", F.lit(".java"))
    return parts.select(path.alias("path"), F.lit(None).cast("string").alias("content_hash"), F.lit(0).cast("long").alias("mtime_ms"), text.alias("content"))


def base(spark: SparkSession, sf_dir: str, often: bool = False) -> commands.CodeBase:
    """The tree's facts; kept in files where a query reads them often, so that sources are parsed once."""
    files = tree(spark, sf_dir)
    facts = code.extract(files)
    return commands.CodeBase(code.Code(kept(facts, "facts") if often else facts, files))


_PACKS = ("loop", "class", "security", "migrate", "compat")
_RULES = ", ".join(f"({i}, '{pack}', '{rule}')" for i, row in enumerate(LINES) for pack, ids in zip(_PACKS, row[1:], strict=True) for rule in ids.split())
_WITH = f"""WITH r AS (SELECT * FROM (VALUES {_RULES}) AS x(i, pack, rule_id)),
f AS (SELECT p_partkey AS k, 'Line' || p_partkey AS class_name, 'src/lines/Line' || p_partkey || '.java' AS path, pack, rule_id FROM part JOIN r ON r.i = p_partkey % {len(LINES)}),
hits AS (SELECT f.*, x.line_no FROM f, (VALUES (6), (18)) AS x(line_no))
"""


@query(_WITH + """SELECT path, line_no, rule_id, pack AS scope, NULL::VARCHAR AS call_path FROM hits WHERE pack = 'class' OR (pack = 'loop' AND line_no = 6)
UNION ALL SELECT path, 18, rule_id, 'called from a loop: ' || class_name || '.hop/1', 'Line' || ((k - 1 + n) % n) || '.call/2 > ' || class_name || '.step/1 > ' || class_name || '.hop/1' FROM f, (SELECT count(*) AS n FROM part) WHERE pack = 'loop'""")
def part_perf_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every performance rule on lines in loops, in classes, and in methods that calls in loops reach, with the calls."""
    return commands.perf(base(spark, sf_dir, often=True), deep=2).select("path", "line_no", "rule_id", "scope", F.array_join("call_path", " > ").alias("call_path"))


@query(_WITH + "SELECT path, class_name, line_no, rule_id, CASE WHEN rule_id IN ('SQL_INJECTION', 'PATH_TRAVERSAL', 'JNDI_INJECTION', 'XXE', 'INSECURE_DESERIALIZATION') THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM hits WHERE pack = 'security'")
def part_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every security rule."""
    return commands.security(base(spark, sf_dir)).select("path", "class_name", "line_no", "rule_id", "severity")


@query(_WITH + "SELECT path, line_no, rule_id FROM hits WHERE pack = 'migrate'")
def part_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migration rules of version 17, a line each."""
    return commands.migrate(base(spark, sf_dir), 17).select("path", "line_no", "rule_id")


@query(_WITH + "SELECT path, line_no, rule_id FROM hits WHERE pack = 'compat'")
def part_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility rules of version 17, a line each."""
    return commands.compat(base(spark, sf_dir), 17).select("path", "line_no", "rule_id")
