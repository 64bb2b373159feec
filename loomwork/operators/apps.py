"""Applications behind a narrow door: what they are, what their calls take, and calls that read or
change their state. State lives in stored tables, one version after the other; a call that changes it
has a key, and repeating the key changes nothing. The caller of a change may lose the reply, and then
reads the state before trying again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.plans.types import TypeFault
from loomwork.sources.storage import store


class ReplyLost(RuntimeError):
    """A change whose outcome the caller does not know."""


@dataclass
class Call:
    """run(state, **arguments) gives a table to read, or the new state if it changes the state."""

    doc: str
    parameters: tuple[str, ...]
    run: Callable[..., DataFrame]
    changes: bool = False


@dataclass
class Application:
    doc: str
    state: DataFrame
    calls: dict[str, Call]
    done: set[str] = field(default_factory=set)


class Applications:
    """profile: facts about the user on whose behalf calls are made."""

    def __init__(self, spark: SparkSession, profile: dict[str, str], apps: dict[str, Application]):
        self.spark, self.user, self.apps = spark, profile, apps
        self.lose_replies = 0

    def profile(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.user.items()), "name string, value string")

    def list_apps(self) -> DataFrame:
        return self.spark.createDataFrame([(n, a.doc, sorted(a.calls)) for n, a in sorted(self.apps.items())], "app string, doc string, calls array<string>")

    def api_doc(self, app: str, call: str) -> DataFrame:
        c = self._call(app, call)
        return self.spark.createDataFrame([(app, call, c.doc, list(c.parameters), c.changes)], "app string, call string, doc string, parameters array<string>, changes boolean")

    def app_call(self, app: str, call: str, arguments: dict, key: str | None = None) -> DataFrame:
        """Exactly the declared parameters. A change needs a key; with one that is done already it
        returns the state as it is."""
        a, c = self.apps[app], self._call(app, call)
        if set(arguments) != set(c.parameters):
            raise TypeFault(f"PARAMETER_UNKNOWN {sorted(set(arguments) ^ set(c.parameters))}")
        if not c.changes:
            return c.run(a.state, **arguments)
        if key is None:
            raise TypeFault("PARAMETER_MISSING key")
        if key not in a.done:
            a.state = store(c.run(a.state, **arguments), app)
            a.done.add(key)
            if self.lose_replies:
                self.lose_replies -= 1
                raise ReplyLost(f"{app}.{call} {key}")
        return a.state

    def _call(self, app: str, call: str) -> Call:
        if app not in self.apps or call not in self.apps[app].calls:
            raise TypeFault(f"no call {app}.{call}")
        return self.apps[app].calls[call]


def ledger(rows: DataFrame) -> Application:
    """Payment requests (member, amount): the only call that changes anything creates one."""

    def create(state: DataFrame, member: int, amount: float) -> DataFrame:
        return state.unionByName(state.sparkSession.range(1).select(F.lit(member).cast("long").alias("member"), F.lit(float(amount)).alias("amount")))

    calls = {
        "create_payment_request": Call("Asks a member for an amount.", ("member", "amount"), create, changes=True),
        "show_payment_requests": Call("All requests to a member.", ("member",), lambda state, member: state.where(F.col("member") == member)),
        "totals": Call("What each member was asked for.", (), lambda state: state.groupBy("member").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))),
    }
    return Application("Requests for payment.", rows, calls)
