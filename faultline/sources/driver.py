"""The engine's relations, derived from the driver's star schema by deterministic expressions.

A defect is an order; its tags come from the customer, its fix references from line items, patches from suppliers, changed
ranges from parts (part p belongs to the patch of supplier p modulo the number of suppliers), and its report is a text put together from the order's numbers. Whole tables are read.
Scans read only the columns used; nothing is cached or collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One title for each type and family, with places for functions.
TITLES = (
    "KASAN: use-after-free Read in {f}", "KASAN: slab-out-of-bounds Write in {f}", "KMSAN: uninit-value in {f}", "KCSAN: data-race in {f} / {g}", "KFENCE: invalid free in {f}",
    "UBSAN: shift-out-of-bounds in {f}", "WARNING in {f}", "INFO: task hung in {f}", "kernel BUG in {f}", "BUG: unable to handle kernel NULL pointer dereference in {f}",
    "kernel panic: corrupted stack end in {f}", "general protection fault in {f}", "possible deadlock in {f}", "memory leak in {f}", "inconsistent lock state in {f}",
    "divide error in {f}", "suspicious RCU usage in {f}", "unregister_netdevice: waiting for DEV to become free", "stack segment fault in {f}", "Internal error in {f}",
    "VFS: Busy inodes after unmount", "invalid opcode in {f}", "unexpected kernel reboot", "lost connection to test machine", "ci-qemu build error",
    "ci-qemu boot error: WARNING in {f}", "ci-qemu test error", "ci2 boot error", "strange  thing in {f}", "UBSAN: signed-integer-overflow in {f}",
)
FOLDERS = ("net/ipv4", "fs/ext4", "drivers/net/wireless", "drivers/net/ethernet/intel", "kernel/bpf", "mm", "arch/x86/kvm", "block", "sound/core", "include/linux", "drivers/usb/core", "io_uring")


def _pick(values, index):
    return F.get(F.array(*map(F.lit, values)), (index % len(values)).cast("int"))


def _function(n, modulus: int = 97):
    return F.concat(F.lit("fn_"), n % modulus)


class DriverTables:
    """Relations over the tables in sf_dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame, name: str) -> DataFrame:
        """df, a view of the table name, dealt to all cores if the table comes in fewer parts: for what is made of each row by much work."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if self.raw(name).rdd.getNumPartitions() < cores else df

    def bugs(self) -> DataFrame:
        """bug_id, position, title, function, custkey, opened, priority, status, weight: listing order is position."""
        o = self.raw("orders")
        key, f = F.col("o_orderkey"), _function(F.col("o_custkey"))
        title = F.replace(F.replace(_pick(TITLES, key), F.lit("{f}"), f), F.lit("{g}"), _function(key, 89))
        return o.select(
            key.alias("bug_id"), key.alias("position"), F.concat(title, F.when(key % 7 == 0, " (2)").otherwise("")).alias("title"), f.alias("function"),
            F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("opened"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("weight"),
        )

    def subsystems(self) -> DataFrame:
        """bug_id, tag: tags that differ only in case are there on purpose."""
        c = self.raw("customer").join(F.broadcast(self.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        tags = F.array_compact(F.array(F.lower("c_mktsegment"), F.col("n_name"), F.when(F.col("n_nationkey") % 5 == 0, F.lower("n_name"))))
        c = c.select(F.col("c_custkey").alias("custkey"), F.explode(F.array_distinct(tags)).alias("tag"))
        return self.bugs().select("bug_id", "custkey").join(c, "custkey").select("bug_id", "tag")

    def fix_refs(self, numbered: bool = False) -> DataFrame:
        """bug_id, kind, position (struct), hash (null for a title-only fix), title, repo: repeated references stay. numbered: hash is the patch's number, as links() has it."""
        part, patch = self.raw("part").select("p_partkey", "p_name", "p_brand"), F.col("l_suppkey")
        l = self.raw("lineitem").join(part.hint("merge") if numbered else part, F.col("l_partkey") == F.col("p_partkey"))
        return l.select(
            F.col("l_orderkey").alias("bug_id"), F.when(F.col("l_linenumber") % 2 == 0, "listing").otherwise("detail").alias("kind"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"),
            F.when(F.col("l_returnflag") != "R", patch if numbered else self.hash_of(patch)).alias("hash"), F.col("p_name").alias("title"), F.col("p_brand").alias("repo"),
        )

    def links(self) -> DataFrame:
        """bug_id, patch: each bug and each patch it refers to, once. A patch's number stands for its hash where many rows are shuffled; hash_of() gives it."""
        l = self.raw("lineitem").where("l_returnflag <> 'R' and l_suppkey is not null").join(self.raw("part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
        return l.select(F.col("l_orderkey").alias("bug_id"), F.col("l_suppkey").alias("patch")).repartition("bug_id").distinct()  # by bug, so that joins by bug need no other shuffle

    @staticmethod
    def hash_of(patch):
        return F.sha2(patch.cast("string"), 256)

    def patches(self) -> DataFrame:
        """hash, suppkey, is_valid, is_complete."""
        s = F.col("s_suppkey")
        return self.raw("supplier").select(F.sha2(s.cast("string"), 256).alias("hash"), s.alias("suppkey"), (s % 5 != 0).alias("is_valid"), (s % 7 != 0).alias("is_complete"))

    def ranges(self) -> DataFrame:
        """hash, old_path, new_path, old_start, old_count, new_count, function, kind: a changed range for each part."""
        return self.numbered_ranges().select(self.hash_of(F.col("patch")).alias("hash"), "old_path", "new_path", "old_start", "old_count", "new_count", "function", "kind")

    def numbered_ranges(self) -> DataFrame:
        """The ranges with their patch's number for its hash, as links() has it."""
        suppliers = self.raw("supplier").agg(F.count("*").alias("n"))  # one row
        p = F.col("p_partkey")
        parts = self.raw("part").select("p_partkey", "p_size").join(F.broadcast(suppliers))
        folder, name = _pick(FOLDERS, F.col("p_size")), F.concat(F.lit("/f"), p % 40, F.lit(".c"))
        path = F.concat(folder, name)
        moved = F.when(p % 19 == 0, F.concat(folder, F.lit("/moved"), name)).otherwise(path)
        return parts.select(
            (p % F.col("n")).alias("patch"), F.when(p % 13 != 0, path).alias("old_path"), F.when(p % 17 != 0, moved).alias("new_path"),
            (p % 500 + 1).alias("old_start"), (F.col("p_size") % 9).cast("long").alias("old_count"), (p % 11).alias("new_count"), _function(p).alias("function"),
            F.when(p % 350 == 0, "binary").when(p % 351 == 0, "unparsed").otherwise("text").alias("kind"),
        )

    def _located(self) -> DataFrame:
        """bugs with path and line of where they show; one in eleven is unresolved."""
        k = F.col("bug_id")
        path = F.concat(_pick(FOLDERS, F.col("custkey")), F.lit("/f"), k % 40, F.lit(".c"))
        return self.bugs().withColumns({"path": F.when(k % 11 != 0, path), "line": F.when(k % 11 != 0, k % 500 + 1)})

    def sites(self) -> DataFrame:
        """bug_id, path, line, function: where a defect shows."""
        return self._located().select("bug_id", "path", "line", "function")

    def reports(self) -> DataFrame:
        """bug_id, title, report: a crash report; one in nine defects has none, one in ten reports is markup."""
        return self.reported().where("bug_id % 9 != 0")  # as reported() has it, but cheaper to ask

    def reported(self) -> DataFrame:
        """bug_id, title, report of every defect; null where there is none."""
        b = self.spread(self._located().select("bug_id", "title", "path", "line", "function"), "orders")
        k, at = F.col("bug_id"), F.concat(F.coalesce("path", F.lit("fs/none.c")), F.lit(":"), F.coalesce("line", F.lit(1)))
        lines = (
            F.col("title"), F.concat(F.when(k % 2 == 0, "Read").otherwise("Write"), F.lit(" of size 8 at addr ffff88 by task exe/"), k % 50), F.lit(""), F.lit("CPU: 0 PID: 7 Comm: exe"), F.lit("Call Trace:"), F.lit(" <TASK>"),
            F.lit(" dump_stack_lvl+0x1/0x2 lib/dump_stack.c:106"), F.concat(F.lit(" "), F.col("function"), F.lit(".constprop.0+0x10/0x20 "), at), F.concat(F.lit(" "), _function(k, 89), F.lit("+0x3/0x4 fs/open.c:"), k % 90 + 1),
            F.lit(" do_syscall_64+0x5/0x6"), F.lit("Allocated by task 7:"), F.lit(" kmem_alloc+0x1/0x9 mm/slab.c:33"), F.concat(F.lit("Freed by task "), k % 3 + 6, F.lit(":")), F.lit(" kfree+0x1/0x9 mm/slab.c:44"),
            F.when(k % 4 == 0, "The buggy address belongs to the object"), F.when(k % 4 == 0, " timer_fn+0x1/0x9 kernel/time/timer.c:5"),
        )
        text = F.concat_ws("\n", *lines)
        return b.select("bug_id", "title", F.when(k % 9 != 0, F.when(k % 10 == 0, F.concat(F.lit("<html>"), text, F.lit("</html>"))).otherwise(text)).alias("report"))

    def payloads(self) -> DataFrame:
        """doc_id, key, content, is_valid: stored payloads; unlabelled documents are of unknown validity (null)."""
        d, l = self.raw("documents"), self.raw("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        return d.join(l, "doc_id", "left").select("doc_id", F.concat(F.lit("id-"), "doc_id").alias("key"), F.col("text").alias("content"), "source", (F.col("quality") == 1).alias("is_valid"))
