"""JUnit XML: one case for the comparison and one for each partition."""

from xml.etree import ElementTree as ET

from evenkeel.result import COUNTERS


def render(result, suite_name: str = "evenkeel") -> str:
    seconds = f"{result.execution_metrics.elapsed_sec:.3f}"
    root = ET.Element("testsuites")
    suite = ET.SubElement(root, "testsuite", name=suite_name, time=seconds)
    case = ET.SubElement(suite, "testcase", classname=f"{suite_name}.{result.compare_mode}", name=f"compare[{','.join(result.keys) or '*'}]", time=seconds)
    if result.status == "ERROR":
        ET.SubElement(case, "error", type="ReconError", message=result.error or "compare failed").text = result.error or ""
    elif result.status == "MISMATCH":
        figures = ", ".join(f"{c}={getattr(result, c)}" for c in COUNTERS)
        ET.SubElement(case, "failure", type="Mismatch", message=figures).text = result.summary()
    for part in result.partitions:
        case = ET.SubElement(suite, "testcase", classname=f"{suite_name}.partition.{result.compare_mode}", name=f"partition[{part['partition']}]", time="0")
        if not part["match"]:
            ET.SubElement(case, "failure", type="Mismatch", message=", ".join(f"{c}={part[c]}" for c in COUNTERS[:3]))
    for name, tag in (("tests", "testcase"), ("failures", "failure"), ("errors", "error")):
        suite.set(name, str(len(list(suite.iter(tag)))))
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")
