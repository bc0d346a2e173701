"""The rule packs. All literals, versions and severities are fixed values."""

from __future__ import annotations

from .rules import Rule

C, W, I = "CRITICAL", "WARNING", "INFO"  # noqa: E741
COLLECTIONS = ("ArrayList", "LinkedList", "HashMap", "LinkedHashMap", "TreeMap", "HashSet", "LinkedHashSet", "TreeSet", "List", "Map", "Set")
STATEMENTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "select", "insert", "update", "delete")
SQL_BEGINS = tuple(f'"{s} ' for s in STATEMENTS)
JNDI = ("InitialContext(", ".lookup(", "new InitialContext")
DAO = ("executeQuery(", "executeUpdate(", "prepareStatement(", "createStatement(", "entityManager.find", "entityManager.persist", "entityManager.merge", "entityManager.remove", "entityManager.createQuery", "entityManager.createNativeQuery", "createNamedQuery", "repository.find", "repository.save", "repository.delete", "Repository.find", "Repository.save", "Repository.delete", "repo.find", "repo.save", "repo.delete", "dao.find", "dao.save", "selectFrom(", "insertInto(", "sqlSession.", "jdbcTemplate.")


def _perf(rule_id: str, severity: str, message: str, **tests) -> Rule:
    return Rule("perf", rule_id, severity, message=message, **tests)


#: Lines inside loops.
PERFORMANCE = [
    _perf("IO", C, "File access in a loop", any_of=("Files.read", "Files.write", "Files.newOutputStream", "new File(", "io.File(", "FileInputStream", "FileOutputStream", "writeToFile", "readFromFile")),
    _perf("ALLOCATION", W, "A collection is made in each turn", any_of=("new HashMap", "new ArrayList", "new LinkedHashMap", "new HashSet", "new LinkedList")),
    _perf("NESTED", W, "A search through a stream in each turn", all_of=(".stream()",), any_of=("noneMatch", "anyMatch", "allMatch", "filter")),
    _perf("STRING_CONCAT", W, "Text grows in a loop", all_of=("+=",), none_of=("++", '"', "String"), regex=r'.*\w+\s*=\s*\w+\s*\+\s*".*', either=True),
    _perf("STRING_FORMAT", I, "Formatting in a loop", any_of=("String.format(", "String.format (")),
    _perf("DATE_FORMAT", W, "A date format is made in each turn", any_of=("new SimpleDateFormat", "new DateFormat", "DateTimeFormatter.ofPattern(")),
    _perf("REGEX_COMPILE", W, "A pattern is compiled in each turn", any_of=("Pattern.compile(", "Pattern.compile (")),
    _perf("REFLECTION", C, "Reflection in a loop", any_of=("Class.forName(", ".getMethod(", ".getDeclaredMethod(", ".invoke(", ".newInstance(", ".getField(", ".getDeclaredField(")),
    _perf("STREAM_CREATE", W, "A stream is made in each turn", any_of=(".stream()", ".parallelStream()")),
    _perf("LIST_REMOVE", W, "Removal while looping", all_of=(".remove(",), none_of=("Iterator",)),
    _perf("DB_QUERY", C, "A query in each turn", any_of=DAO),
    _perf("BOXING", I, "Boxing in a loop", any_of=("Integer.valueOf(", "Long.valueOf(", "Double.valueOf(", "Float.valueOf(", "Boolean.valueOf(", "Integer.parseInt(", "Long.parseLong(", "Double.parseDouble(")),
    _perf("VECTOR_HASHTABLE", W, "A synchronised legacy collection", any_of=("new Vector", "new Hashtable", "Vector<", "Hashtable<")),
    _perf("TABLE_FIRE", C, "Table events in a loop", any_of=("fireTableDataChanged(", "fireTableRowsInserted(", "fireTableRowsUpdated(", "fireTableRowsDeleted(", "fireTableCellUpdated(")),
    _perf("JNDI_LOOKUP", C, "A directory lookup in each turn", any_of=JNDI),
    _perf("SELECT_STAR", W, "All columns are selected", any_of=('"SELECT *', '"select *', "'SELECT *", "'select *")),
    _perf("SQL_CONCAT", C, "A statement is built from text", any_of=SQL_BEGINS, all_of=('" +',)),
    _perf("CONNECTION", C, "A connection in each turn", any_of=("getConnection(", "openConnection(", "openStream(", "new Socket(", "new URL(")),
]
#: Lines anywhere in a class.
STRUCTURAL = [
    Rule("perf", "STATIC_MUTABLE_COLLECTION", C, all_of=("static", "new "), none_of=("final",), any_of=COLLECTIONS, message="A shared collection that can be replaced"),
    Rule("perf", "UNBOUNDED_CACHE", W, all_of=("static", "Map"), none_of=("final",), any_of=("new HashMap", "new ConcurrentHashMap", "new LinkedHashMap"), message="A cache without a bound"),
    Rule("perf", "FINALIZE_METHOD", C, any_of=("void finalize()", "void finalize ()"), message="A finaliser"),
    Rule("perf", "STRINGBUFFER_SINGLE", I, any_of=("new StringBuffer",), message="A synchronised buffer"),
    Rule("perf", "VECTOR_HASHTABLE", W, any_of=("new Vector", "new Hashtable"), message="A synchronised legacy collection"),
    Rule("perf", "SQL_CONCAT", C, any_of=SQL_BEGINS, all_of=('" +',), message="A statement is built from text"),
]
SECURITY = [
    Rule("security", "SQL_INJECTION", C, any_of=SQL_BEGINS, all_of=('" +',), message="A statement is built from text"),
    Rule("security", "PATH_TRAVERSAL", C, any_of=("new File(", "Paths.get(", "Path.of("), also_any=("request.", "param", "input", "getParameter"), message="A path from input"),
    Rule("security", "JNDI_INJECTION", C, any_of=JNDI, message="A directory lookup"),
    Rule("security", "XXE", C, any_of=("DocumentBuilderFactory", "SAXParserFactory", "XMLInputFactory", "TransformerFactory", "SchemaFactory"), message="An XML parser that may read outside entities"),
    Rule("security", "INSECURE_DESERIALIZATION", C, any_of=("ObjectInputStream", ".readObject(", "readUnshared("), message="Objects are read from bytes"),
    Rule("security", "WEAK_CRYPTO", W, any_of=tuple(f'"{x}"' for x in ("MD5", "SHA1", "SHA-1", "DES", "RC4", "RC2", "Blowfish", "DESede")), message="A weak algorithm"),
    Rule("security", "HARDCODED_SECRET", W, any_of=("password", "passwd", "secret", "apikey", "api_key", "token"), fold=True, all_of=('= "',), none_of=("// ",), regex=r"(?i)(?!\*)(?!.*(?:example|test|mock)).*", message="A secret in the source"),
    Rule("security", "INSECURE_RANDOM", W, any_of=("new Random(", "util.Random("), message="A predictable generator"),
    Rule("security", "OPEN_REDIRECT", W, any_of=("sendRedirect(", 'setHeader("Location"'), also_any=("request.", "param", "getParameter", "url"), message="A redirect from input"),
    Rule("security", "LDAP_INJECTION", W, any_of=(".search(", "SearchControls"), also_any=('" +', '+ "'), message="A filter is built from text"),
]


def _move(rule_id: str, category: str, since: int, message: str, **tests) -> Rule:
    return Rule("migrate", rule_id, "INFO", since=since, category=category, message=message, **tests)


MIGRATION = [
    _move("DIAMOND_OPERATOR", "syntax", 7, "Type arguments can be left out", all_of=("new ",), none_of=("<>",), any_of=COLLECTIONS, regex=r".*new\s+\w+<.+>\s*\(.*"),
    _move("MULTICATCH", "syntax", 7, "Catches can be joined", regex=r"(?:\} )?catch \(.*"),
    _move("TRY_WITH_RESOURCES", "syntax", 7, "Resources can be closed by the block", all_of=("finally", "{")),
    _move("DATE_LEGACY", "api", 8, "The newer time classes do this", any_of=("new Date(", "Calendar.getInstance", "new GregorianCalendar", "new SimpleDateFormat", "DateFormat.get")),
    _move("VECTOR_USAGE", "api", 8, "A list does this", any_of=("new Vector", "Vector<")),
    _move("HASHTABLE_USAGE", "api", 8, "A map does this", any_of=("new Hashtable", "Hashtable<")),
    _move("STRINGBUFFER_USAGE", "api", 8, "A builder does this", any_of=("new StringBuffer", "StringBuffer ")),
    _move("URL_CONSTRUCTOR", "api", 20, "Addresses are made from URIs", all_of=("new URL(",), none_of=("new URL(url",)),
    *(_move(f"JAVAX_{n}", "jakarta", 9, "The package has moved", any_of=(p,)) for n, p in (("SERVLET", "javax.servlet"), ("PERSISTENCE", "javax.persistence"), ("EJB", "javax.ejb"), ("INJECT", "javax.inject"), ("WS", "javax.ws.rs"), ("VALIDATION", "javax.validation"))),
    _move("COLLECTIONS_UNMODIFIABLE", "feature", 9, "Immutable factories do this", any_of=("Collections.unmodifiableList", "Collections.unmodifiableMap", "Collections.unmodifiableSet")),
    _move("LOCAL_VAR_TYPE", "feature", 10, "The type can be inferred", regex=r"[A-Z]\w*(?:<.*>)?\s+\w+\s*=\s*(?:new\s+\w+.*|\w+(?:\.\w+)*\(.*);"),
    _move("INSTANCEOF_CAST", "feature", 16, "A pattern can bind the name", all_of=("instanceof ",), regex=r".*instanceof\s+\w+\s*[)&|{].*"),
    _move("COLLECTIONS_EMPTY", "feature", 9, "Immutable factories do this", any_of=("Collections.emptyList()", "Collections.emptyMap()", "Collections.emptySet()")),
    *(_move(f"SYNCHRONIZED_{n.upper()}", "feature", 5, "Concurrent collections do this", any_of=(f"Collections.synchronized{n}(",)) for n in ("Map", "List", "Set")),
    _move("LAMBDA_VAR", "feature", 11, "Parameters can be typed by inference", all_of=("->",), regex=r".*\(\s*[a-z]\w*\s*,\s*[a-z]\w*\s*\)\s*->.*"),
    _move("TEXT_BLOCK", "feature", 15, "A text block does this", any_of=('"\\n" +', '+ "\\n"'), regex=r'.*" \+.*\\n";', either=True),
    _move("HTTP_CLIENT", "api", 11, "The newer client does this", any_of=("HttpURLConnection", "URLConnection")),
    _move("NASHORN_ENGINE", "deprecated", 15, "The engine is gone", any_of=('"nashorn"', "jdk.nashorn")),
    _move("SECURITY_MANAGER", "deprecated", 17, "The manager is going", any_of=("SecurityManager",)),
    _move("APPLET_REMOVED", "deprecated", 17, "Applets are going", any_of=("java.applet", "extends Applet")),
    _move("FINALIZE_OVERRIDE", "deprecated", 9, "Finalisers are going", any_of=("void finalize()", "void finalize ()")),
    _move("THREAD_STOP", "deprecated", 1, "Threads must be asked to end", any_of=(".stop()", ".suspend()", ".resume()")),
    _move("MAP_GET_OR_DEFAULT", "feature", 9, "One call does this", all_of=("containsKey", "?", ".get(")),
    _move("OPTIONAL_OR_ELSE", "feature", 9, "One call does this", all_of=(".isPresent()", "?", ".get()")),
    _move("STRING_STRIP", "feature", 11, "The newer call knows all blanks", any_of=(".trim()",)),
    _move("STREAM_TO_LIST", "feature", 16, "The stream can do this", any_of=("Collectors.toList()", "Collectors.toSet()")),
]


def _gone(rule_id: str, since: int, **tests) -> Rule:
    return Rule("compat", rule_id, W, since=since, category="removed", message=f"Removed in version {since}", **tests)


COMPATIBILITY = [
    _gone("JAXB", 9, any_of=("javax.xml.bind",)), _gone("JAX_WS", 9, any_of=("javax.xml.ws",)), _gone("ACTIVATION", 9, any_of=("javax.activation",)),
    _gone("CORBA", 9, any_of=("org.omg.CORBA", "org.omg.PortableServer")), _gone("NASHORN", 11, any_of=("jdk.nashorn", "ScriptEngineManager")),
    _gone("JAVA_EE_MODULES", 11, all_of=("javax.annotation.",), none_of=("javax.annotation.processing",)), _gone("SECURITY_ACL", 14, any_of=("java.security.acl",)),
    _gone("ILLEGAL_ACCESS", 16, any_of=("setAccessible(true)",)), _gone("RMI_ACTIVATION", 17, any_of=("java.rmi.activation",)), _gone("APPLET", 17, any_of=("java.applet", "extends Applet")),
    _gone("SUN_MISC", 9, any_of=("sun.misc.Unsafe", "sun.misc.BASE64")), _gone("COM_SUN_INTERNAL", 9, all_of=("com.sun.",), none_of=("com.sun.jna", "com.sun.xml.bind")),
    _gone("FINALIZE", 9, any_of=("void finalize()",)),
]
#: Marks in comments, first in order wins.
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "NOSONAR", "WORKAROUND")
#: Numbers that need no name.
BENIGN_NUMBERS = ("0", "1", "-1", "0L", "1L", "-1L", "0.0", "1.0", "-1.0", "0l", "1l", "-1l", "0d", "1d", "0.0d", "1.0d", "0f", "1f")
GENERIC_EXCEPTIONS = ("Exception", "Throwable", "RuntimeException")
MAX_METHOD, MAX_PARAMS, GOD_LOC, GOD_METHODS = 30, 5, 500, 30
#: Annotations of entry points.
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "GET"}
REST = (*VERBS, "Path", "GET")
SCHEDULED = ("Scheduled", "Schedules")
LISTENERS = ("EventListener", "KafkaListener", "RabbitListener", "JmsListener", "SqsListener", "TransactionalEventListener")
#: Methods of every object, left out of matches by name.
OBJECT_METHODS = ("equals", "hashCode", "toString", "getClass", "clone", "notify", "notifyAll", "wait", "finalize")
LAYER_SUFFIXES = ("Controller", "Service", "Repository", "Dao", "Mapper", "Factory", "Handler", "Listener", "Config", "Util", "Entity")
DAO_NAMES = ("Dao", "DAO", "Repository", "Mapper")
DAO_SUPERS = ("Dao", "DAO", "Repository", "Mapper", "JdbcTemplate")
DAO_INTERFACES = ("Repository", "Dao", "Mapper")
PREFIXES = ("get", "set", "is", "find", "create", "update", "delete", "add", "remove", "handle")
LOGGERS = ("org.slf4j", "org.apache.log4j", "org.apache.logging.log4j", "java.util.logging")
INJECTIONS = ("Autowired", "Inject", "Resource")
#: Types too common to make two classes related.
#: Groups of words that a search by concepts takes for one another, in the order in which they are tried.
SYNONYMS = {
    "database": ("database", "datasource", "jdbc", "jpa", "repository", "sql", "persistence", "hibernate", "entity", "db"),
    "error": ("error", "exception", "failureanalyzer", "handler", "fallback", "catch", "throw", "fault"),
    "handle": ("handle", "handler", "process", "catch", "on", "listener", "intercept"),
    "auth": ("security", "authentication", "authorization", "token", "credential", "principal", "login", "oauth"),
    "http": ("controller", "servlet", "request", "response", "endpoint", "mapping", "rest", "web", "filter"),
    "config": ("configuration", "properties", "settings", "preference", "profile", "environment", "yaml"),
    "test": ("test", "mock", "stub", "fixture", "assert", "verify", "testcontainers"),
    "cache": ("cache", "caffeine", "redis", "ehcache", "caching", "evict"),
    "message": ("message", "queue", "kafka", "rabbit", "jms", "event", "listener", "publisher", "consumer"),
    "log": ("logger", "log", "logging", "slf4j", "logback", "log4j"),
    "serial": ("serializ", "jackson", "json", "xml", "marshal", "objectmapper", "gson"),
    "async": ("async", "future", "completable", "executor", "thread", "parallel", "reactive", "flux", "mono"),
    "valid": ("valid", "constraint", "validator", "bindingresult", "error", "reject"),
    "schedule": ("schedule", "cron", "timer", "periodic", "trigger", "taskscheduler"),
    "file": ("file", "path", "resource", "stream", "reader", "writer", "io", "nio"),
    "ssl": ("ssl", "tls", "certificate", "keystore", "truststore", "pem", "jks"),
}
#: Beyond these a method is large (and below the end of a plausible one) or called very often.
LARGE_METHOD, IMPLAUSIBLE_METHOD, HOT_METHOD = 50, 5000, 100
COMMON_TYPES = ("String", "Integer", "Long", "Double", "Float", "Boolean", "Object", "List", "Map", "Set", "Collection", "Optional", "ArrayList", "HashMap", "HashSet", "Date", "BigDecimal", "int", "long", "double", "float", "boolean", "byte", "char", "short", "void", "var")
HIDDEN_IMPORTS = r"^(java|javax|jakarta|org\.slf4j|org\.apache\.commons)\."
