"""Names of common framework types by namespace, with their number of type parameters; a class is marked, the rest isn't told apart.

The table is small: a framework name outside of it is taken for an unknown one.
"""

from __future__ import annotations

#: Namespaces that a file without usings sees. Fixed values.
IMPLICIT = ("System", "System.Collections.Generic", "System.IO", "System.Linq", "System.Net.Http", "System.Threading", "System.Threading.Tasks")
#: Names by namespace; ``/n``: type parameters.
_NAMES = {
    "System": "Action/0 Action/1 Action/2 Action/3 ArgumentException ArgumentNullException ArgumentOutOfRangeException Array Attribute BitConverter Console Convert DateOnly DateTime DateTimeOffset DayOfWeek Delegate Enum Environment EventArgs EventHandler EventHandler/1 Exception Func/1 Func/2 Func/3 Func/4 GC Guid IAsyncDisposable ICloneable IComparable IComparable/1 IDisposable IEquatable/1 IFormatProvider IProgress/1 IServiceProvider InvalidOperationException Lazy/1 Math Memory/1 NotImplementedException NotSupportedException Nullable/1 Object ObsoleteAttribute OperationCanceledException Predicate/1 Random ReadOnlyMemory/1 ReadOnlySpan/1 Span/1 String StringComparer StringComparison TimeOnly TimeSpan TimeProvider TimeoutException Tuple/2 Type Uri ValueTuple/2 Version",
    "System.Collections": "ICollection IEnumerable IEnumerator IList",
    "System.Collections.Concurrent": "ConcurrentBag/1 ConcurrentDictionary/2 ConcurrentQueue/1",
    "System.Collections.Generic": "Dictionary/2 HashSet/1 IAsyncEnumerable/1 ICollection/1 IComparer/1 IDictionary/2 IEnumerable/1 IEnumerator/1 IEqualityComparer/1 IList/1 IReadOnlyCollection/1 IReadOnlyDictionary/2 IReadOnlyList/1 IReadOnlySet/1 ISet/1 KeyValuePair/2 LinkedList/1 List/1 PriorityQueue/2 Queue/1 SortedDictionary/2 SortedSet/1 Stack/1",
    "System.IO": "Directory DirectoryInfo File FileInfo FileMode FileStream IOException InvalidDataException MemoryStream Path Stream StreamReader StreamWriter StringReader StringWriter TextReader TextWriter",
    "System.Linq": "Enumerable IGrouping/2 ILookup/2 IOrderedEnumerable/1 IQueryable/1 Queryable",
    "System.Linq.Expressions": "Expression Expression/1",
    "System.Net": "HttpStatusCode IPAddress",
    "System.Net.Http": "HttpClient HttpMethod HttpRequestMessage HttpResponseMessage",
    "System.Text": "Encoding StringBuilder",
    "System.Text.Json": "JsonDocument JsonElement JsonSerializer JsonSerializerOptions",
    "System.Text.RegularExpressions": "Match Regex RegexOptions",
    "System.Threading": "CancellationToken CancellationTokenSource Interlocked Monitor SemaphoreSlim Thread Timer",
    "System.Threading.Channels": "Channel Channel/1",
    "System.Threading.Tasks": "Task Task/1 TaskCompletionSource/1 ValueTask ValueTask/1",
    "Microsoft.AspNetCore.Authorization": "AllowAnonymousAttribute AuthorizeAttribute",
    "Microsoft.AspNetCore.Http": "HttpContext HttpRequest HttpResponse IFormFile IResult",
    "Microsoft.AspNetCore.Mvc": "ActionResult ActionResult/1 ControllerBase Controller IActionResult ApiControllerAttribute RouteAttribute",
    "Microsoft.Extensions.Configuration": "IConfiguration",
    "Microsoft.Extensions.DependencyInjection": "IServiceCollection IServiceScopeFactory",
    "Microsoft.Extensions.Hosting": "BackgroundService IHost IHostedService",
    "Microsoft.Extensions.Logging": "ILogger ILogger/1 ILoggerFactory",
    "Microsoft.Extensions.Options": "IOptions/1 IOptionsMonitor/1",
}
#: Types that have a keyword. Fixed values.
KEYWORDS = {"System.String": "string", "System.Object": "object"}

_TABLE = {(ns, *(x.split("/") if "/" in x else (x, "0"))) for ns, names in _NAMES.items() for x in names.split()}
_PLACES: dict[tuple[str, int], list[str]] = {}
for _ns, _name, _arity in sorted(_TABLE):
    _PLACES.setdefault((_name, int(_arity)), []).append(_ns)


def find(name: str, arity: int, opened: list[str]) -> str | None:
    """The first of the opened namespaces that has the type."""
    places = _PLACES.get((name, arity), ())
    return next((ns for ns in opened if ns in places), None)


def is_interface(name: str) -> bool:
    """Whether a framework type is an interface: those of the table are named like one, and no class is."""
    plain = name.rpartition(".")[2]
    return len(plain) > 1 and plain[0] == "I" and plain[1].isupper() and plain not in ("IOException", "IPAddress")
