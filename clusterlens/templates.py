"""Accounting-log record templates.

A template is the ordered list of field names of one record type, the
variable-length groups inside it, and which fields must be numbers.
Everything below the FIXED VALUES marker must equal the scheduler's log
format, so it is written out as data, in the order the log uses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

# ---------------------------------------------------------------------------
# FIXED VALUES: field order of each record type, as the log writes them.
# ---------------------------------------------------------------------------

JOB_FINISH_FIELDS = [
    "Event Type", "Version Number", "Event Time", "jobId", "userId",
    "options", "numProcessors", "submitTime", "beginTime", "termTime",
    "startTime", "userName", "queue", "resReq", "dependCond",
    "preExecCmd", "fromHost", "cwd", "inFile", "outFile", "errFile",
    "jobFile", "numAskedHosts", "askedHosts", "numExHosts", "execHosts",
    "jStatus", "hostFactor", "jobName", "command", "ru_utime", "ru_stime",
    "ru_maxrss", "ru_ixrss", "ru_ismrss", "ru_idrss", "ru_isrss",
    "ru_minflt", "ru_majflt", "ru_nswap", "ru_inblock", "ru_oublock",
    "ru_ioch", "ru_msgsnd", "ru_msgrcv", "ru_nsignals", "ru_nvcsw",
    "ru_nivcsw", "ru_exutime", "mailUser", "projectName", "exitStatus",
    "maxNumProcessors", "loginShell", "timeEvent", "idx", "maxRMem",
    "maxRSwap", "inFileSpool", "commandSpool", "rsvId", "sla",
    "exceptMask", "additionalInfo", "exitInfo", "warningAction",
    "warningTimePeriod", "chargedSAAP", "licenseProject", "app",
    "postExecCmd", "runtimeEstimation", "jobGroupName", "requeueEvalues",
    "options2", "resizeNotifyCmd", "lastResizeTime", "rsvId",
    "jobDescription", "submitEXT_Num", "submitEXT_key", "submitEXT_value",
    "numHostRusage", "hostRusage_hostname", "hostRusage_mem",
    "hostRusage_swap", "hostRusage_utime", "hostRusage_stime",
    "options3", "runLimit", "avgMem", "effectiveResReq", "srcCluster",
    "srcJobId", "dstCluster", "dstJobId", "forwardTime", "flow_id",
    "acJobWaitTime", "totalProvisionTime", "outdir", "runTime", "subcwd",
    "num_network", "networkID", "networkAlloc_num_window",
    "networkAlloc_affinity", "serial_job_energy", "cpi", "gips", "gbs",
    "gflops", "numAllocSlots", "allocSlots", "ineligiblePendTime",
    "indexRangeCnt", "indexRangeStart1", "indexRangeEnd1",
    "indexRangeStep1", "indexRangeStartN", "indexRangeEndN",
    "indexRangeStepN", "requeueTime", "numGPURusages", "gRusage_hostname",
    "gRusage_numKVP", "gRusage_key", "gRusage_value", "storageInfoC",
    "storageInfoV", "finishKVP_numKVP", "finishKVP_key", "finishKVP_value",
]

# Count field -> number of parallel arrays that follow it, in log order
# (the order matters: each group shifts the positions of the next ones).
JOB_FINISH_GROUPS = [
    ("numAskedHosts", 1),
    ("numExHosts", 1),
    ("submitEXT_Num", 2),
    ("numHostRusage", 5),
    ("num_network", 2),
    ("numAllocSlots", 1),
    ("indexRangeCnt", 6),
    ("numGPURusages", 4),
    ("storageInfoC", 1),
    ("finishKVP_numKVP", 2),
]

JOB_FINISH_INTS = [
    "Event Time", "jobId", "userId", "numProcessors", "submitTime",
    "beginTime", "termTime", "startTime", "numAskedHosts", "numExHosts",
    "jStatus", "exitStatus", "maxNumProcessors", "idx", "maxRMem",
    "maxRSwap", "numHostRusage", "lastResizeTime", "runLimit", "avgMem",
    "num_network", "numAllocSlots", "numGPURusages", "acJobWaitTime",
]

JOB_FINISH_FLOATS = ["hostFactor", "serial_job_energy"]

JOB_RESIZE_FIELDS = [
    "Event Type", "Event Time", "jobId", "tdx", "startTime", "userId",
    "userName", "resizeType", "lastResizeTime", "numExecHosts",
    "execHosts", "numResizeHosts", "resizeHosts", "numAllocSlots",
    "allocSlots", "numResizeSlots", "resizeSlots",
]

JOB_RESIZE_GROUPS = [
    ("numExecHosts", 1),
    ("numResizeHosts", 1),
    ("numAllocSlots", 1),
    ("numResizeSlots", 1),
]

# Record types the log knows but whose layout is not trusted here
# (reservation records): recognised, never parsed.
UNSUPPORTED_TYPES = ["EVENT_ADRSV_FINISH"]

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

# The resize record has no number list of its own in the log format notes;
# its group counts must be integers to be folded at all, and its times and
# ids are numbers, so they are typed here (our choice).
JOB_RESIZE_INTS = [
    "Event Time", "jobId", "startTime", "userId", "lastResizeTime",
    "numExecHosts", "numResizeHosts", "numAllocSlots", "numResizeSlots",
]


def snake_case(name: str) -> str:
    """`numGPURusages` -> `num_gpu_rusages`, `Event Time` -> `event_time`."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_")
    return s.lower()


def unique_snake_names(names: list[str]) -> list[str]:
    """snake_case every name; a repeated name gets a numeric suffix (`rsv_id2`)."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        s = snake_case(n)
        k = seen.get(s, 0) + 1
        seen[s] = k
        out.append(s if k == 1 else f"{s}{k}")
    return out


@dataclass(frozen=True)
class Template:
    record_type: str
    fields: list[str]
    groups: list[tuple[str, int]]
    ints: list[str] = field(default_factory=list)
    floats: list[str] = field(default_factory=list)

    @cached_property
    def columns(self) -> list[str]:
        return unique_snake_names(self.fields)

    def group_spec(self) -> list[tuple[int, int]]:
        """(template index of the count field, width) in log order."""
        return list(self._spec)

    @cached_property
    def _spec(self) -> tuple[tuple[int, int], ...]:
        return tuple((self.fields.index(f), w) for f, w in self.groups)

    def array_columns(self) -> set[int]:
        return set(self._arrays)

    @cached_property
    def _arrays(self) -> frozenset[int]:
        out = set()
        for i, w in self._spec:
            out.update(range(i + 1, i + 1 + w))
        return frozenset(out)

    @cached_property
    def _kinds(self) -> tuple[str, ...]:
        out = []
        for i, name in enumerate(self.fields):
            if i in self._arrays:
                out.append("array")
            # A repeated name (rsvId) is typed like its first occurrence.
            elif name in self.ints:
                out.append("bigint")
            elif name in self.floats:
                out.append("double")
            else:
                out.append("string")
        return tuple(out)

    def kind(self, i: int) -> str:
        return self._kinds[i]


TEMPLATES = {
    "JOB_FINISH": Template("JOB_FINISH", JOB_FINISH_FIELDS, JOB_FINISH_GROUPS,
                           JOB_FINISH_INTS, JOB_FINISH_FLOATS),
    "JOB_RESIZE": Template("JOB_RESIZE", JOB_RESIZE_FIELDS, JOB_RESIZE_GROUPS,
                           JOB_RESIZE_INTS, []),
}
