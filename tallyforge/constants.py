"""Mapping tables, description patterns and discount tiers.

Everything here is a value that results depend on, kept as plain text.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Machine type key, CPU price key, CPUs per core, RAM price key.
CPU_MAPPING_CSV = """\
a2-custom,A2 Instance Core,1,A2 Instance Ram
a2-highgpu,A2 Instance Core,1,A2 Instance Ram
a2-megagpu,A2 Instance Core,1,A2 Instance Ram
c2-standard,Compute optimized Core,1,Compute optimized Ram
e2-custom,Custom Instance Core,1,Custom Instance Ram
e2-highcpu,E2 Instance Core,1,E2 Instance Ram
e2-highmem,E2 Instance Core,1,E2 Instance Ram
e2-medium,E2 Instance Core,2,E2 Instance Ram
e2-micro,E2 Instance Core,8,E2 Instance Ram
e2-small,E2 Instance Core,4,E2 Instance Ram
e2-standard,E2 Instance Core,1,E2 Instance Ram
f1-micro,Micro Instance with burstable CPU,1,
g1-small,Small Instance with 1 VCPU,1,
m1-megamem,Memory-optimized Instance Core,1,Memory-optimized Instance Ram
m1-ultramem,Memory-optimized Instance Core,1,Memory-optimized Instance Ram
n1-custom,Custom Instance Core,1,Custom Instance Ram
n1-highcpu,N1 Predefined Instance Core,1,N1 Predefined Instance Ram
n1-highmem,N1 Predefined Instance Core,1,N1 Predefined Instance Ram
n1-standard,N1 Predefined Instance Core,1,N1 Predefined Instance Ram
n2-custom,N2 Custom Instance Core,1,N2 Custom Instance Ram
n2-highcpu,N2 Instance Core,1,N2 Instance Ram
n2-highmem,N2 Instance Core,1,N2 Instance Ram
n2-standard,N2 Instance Core,1,N2 Instance Ram
n2d-custom,N2D AMD Custom Instance Core,1,N2D AMD Custom Instance Ram
n2d-highcpu,N2D AMD Instance Core,1,N2D AMD Instance Ram
n2d-highmem,N2D AMD Instance Core,1,N2D AMD Instance Ram
n2d-standard,N2D AMD Instance Core,1,N2D AMD Instance Ram
"""

# Accelerator type key, GPU price key.
GPU_MAPPING_CSV = """\
nvidia-tesla-a100,Nvidia Tesla A100
nvidia-tesla-k80,Nvidia Tesla K80
nvidia-tesla-p100,Nvidia Tesla P100
nvidia-tesla-p4,Nvidia Tesla P4
nvidia-tesla-t4,Nvidia Tesla T4
nvidia-tesla-v100,Nvidia Tesla V100
"""

# Disk type key, persistent-disk price key.
PD_MAPPING_CSV = """\
pd-extreme,Extreme PD Capacity
pd-standard,Storage PD Capacity
pd-balanced,Balanced PD Capacity
pd-ssd,SSD backed PD Capacity
"""

# Image license key, license price key, confidence in the guess.
LICENSE_MAPPING_CSV = """\
centos-6,CentOS 6,high
centos-7,CentOS 7,high
centos-8,CentOS 8,high
cos,Container-Optimized OS from Google,low
debian-8-jessie,Debian 8 Jessie,high
debian-9-stretch,Debian 9 Stretch,high
debian-10-buster,Debian 10 Buster,high
debian-10-bullseye,Debian 11 Bullseye,medium
fedora-coreos-next,Fedora CoreOS Next,high
fedora-coreos-stable,Fedora CoreOS Stable,high
fedora-coreos-testing,Fedora CoreOS Testing,high
rhel-7-4-sap,RHEL 7 for SAP Applications,low
rhel-7-7-sap-ha,RHEL 7 for SAP HANA,low
rhel-8-2-sap-ha,Red Hat Enterprise Linux for SAP with High Availability and Update Services,low
rhel-6,RedHat Enterprise Linux 6,medium
rhel-7,RedHat Enterprise Linux 7,medium
rhel-8,RedHat Enterprise Linux 8,medium
sles-12-sap,SLES 12 for SAP,low
sles-15-sap,SLES 15 For SAP License,low
sles-12,SUSE Linux Enterprise 12,medium
sles-15,SUSE Linux Enterprise Server 15,medium
sql-2012-enterprise-windows-2012-r2-dc,SQL Server 2012 Enterprise,low
sql-2012-standard-windows-2012-r2-dc,SQL Server 2012 Standard,low
sql-2012-web-windows-2012-r2-dc,SQL Server 2012 Web,low
sql-2014-enterprise-windows-2012-r2-dc,SQL Server 2014 Enterprise,low
sql-2014-enterprise-windows-2016-dc,SQL Server 2014 Enterprise,low
sql-2014-standard-windows-2012-r2-dc,SQL Server 2014 Standard,low
sql-2014-web-windows-2012-r2-dc,SQL Server 2014 Web,low
sql-2016-enterprise-windows-2012-r2-dc,SQL Server 2016 Enterprise,low
sql-2016-enterprise-windows-2016-dc,SQL Server 2016 Enterprise,low
sql-2016-enterprise-windows-2019-dc,SQL Server 2016 Enterprise,low
sql-2016-standard-windows-2012-r2-dc,SQL Server 2016 Standard,low
sql-2016-standard-windows-2016-dc,SQL Server 2016 Standard,low
sql-2016-standard-windows-2019-dc,SQL Server 2016 Standard,low
sql-2016-web-windows-2012-r2-dc,SQL Server 2016 Web,low
sql-2016-web-windows-2016-dc,SQL Server 2016 Web,low
sql-2016-web-windows-2019-dc,SQL Server 2016 Web,low
sql-2017-enterprise-windows-2016-dc,SQL Server 2017 Enterprise,low
sql-2017-enterprise-windows-2019-dc,SQL Server 2017 Enterprise,low
sql-2017-express-windows-2012-r2-dc,SQL Server 2017 Express,low
sql-2017-express-windows-2016-dc,SQL Server 2017 Express,low
sql-2017-express-windows-2019-dc,SQL Server 2017 Express,low
sql-2017-standard-windows-2016-dc,SQL Server 2017 Standard,low
sql-2017-standard-windows-2019-dc,SQL Server 2017 Standard,low
sql-2017-web-windows-2016-dc,SQL Server 2017 Web,low
sql-2017-web-windows-2019-dc,SQL Server 2017 Web,low
ubuntu-1604-lts,Ubuntu 16.04 (Xenial Xerus),medium
ubuntu-1804-lts,Ubuntu 18.04 LTS (Bionic Beaver),medium
ubuntu-2004-lts,Ubuntu 20.04 LTS (Focal Fossa),high
ubuntu-minimal-1604-lts,Ubuntu Minimal 16.04 LTS (Xenial Xerus),medium
ubuntu-minimal-1804-lts,Ubuntu Minimal 18.04 LTS (Bionic Beaver),medium
ubuntu-minimal-2004-lts,Ubuntu Minimal 20.04 LTS (Focal Fossa),medium
windows-server-2004-dc-core,Windows Server Core,low
windows-server-2012-r2-dc-core,Windows Server Core,low
windows-server-2012-r2-dc,Windows Server 2012 R2 Datacenter Edition,low
windows-server-2016-dc-core,Windows Server Core,low
windows-server-2016-dc,Windows Server 2016 Datacenter Edition,low
windows-server-2019-dc-core-for-containers,Windows container host,low
windows-server-2019-dc-core,Windows Server Core,low
windows-server-2019-dc-for-containers,Windows container host,low
windows-server-2019-dc,Windows Server 2019 Datacenter Edition,low
windows-server-20h2-dc-core,Windows Server Core,low
"""

# Description fragments that decide which table a SKU belongs to.
EXCLUDED_FRAGMENTS = (
    "Sole Tenancy",
    "Proxy Instance Charge",
    "Upgrade Premium",
    "Reserved",
    "Commitment",
)
COMPUTE_SERVICE_FRAGMENT = "Compute"
PREEMPTIBLE_FRAGMENT = "reemptible"

# Patterns that cut a price key or a size bound out of a description.
CORE_KEY_PATTERN = "(.*) in .*"
GPU_KEY_PATTERN = ".*Nvidia (.*) GPU .*"
PD_KEY_PATTERN = "(.*) PD Capacity.*"
IP_KEY_PATTERN = "(.*) on a .*"
LICENSE_PATTERN = "Licensing Fee for (.*)"
LICENSE_ON_VM_PATTERN = "Licensing Fee for (.*) on VM with .*"
LICENSE_ON_CLASS_PATTERN = "Licensing Fee for (.*) on .*"
UP_TO_PATTERN = ".* on VM with up to ([0-9]+) {unit}"
RANGE_HIGH_PATTERN = ".* on VM with [0-9]+ to ([0-9]+) {unit}"
RANGE_LOW_PATTERN = ".* on VM with ([0-9]+) to [0-9]+ {unit}"
OR_MORE_PATTERN = ".* on VM with ([0-9]+) or more {unit}"
EXACT_PATTERN = ".* on VM with ([0-9]+) {unit}"
SMALL_MACHINE_CLASSES = ("g1-small", "f1-micro")

# Sustained-use tiers as (machine class, minutes exceeded, multiplier).
SUSTAINED_USE_TIERS = (
    ("n1", 0, 1.0),
    ("n1", 10950, 0.8),
    ("n1", 21900, 0.6),
    ("n1", 32850, 0.4),
    ("n2", 0, 1.0),
    ("n2", 10950, 0.8678),
    ("n2", 21900, 0.733),
    ("n2", 32850, 0.6),
)

# Unit each cost component must be priced in.
COMPONENT_UNITS = {
    "cpu": "HOUR",
    "ram": "GIBIBYTE_HOUR",
    "gpu": "HOUR",
    "cpu_lic": "HOUR",
    "gpu_lic": "HOUR",
    "ram_lic": "GIBIBYTE_HOUR",
    "disk": "GIBIBYTE_MONTH",
}

# Lengths and thresholds of the cost model.
USAGE_SLOTS = 13
CONTROLLER_MONTH_HOURS = 730.0
ESTIMATOR_MONTH_DAYS = 30.0
MIN_CHARGE = 0.00001
CHARGE_DEPTH = 4
NO_DESCRIPTION = "No description collected"
ALERT_EGRESS = "1"
ALERT_OVER_BUDGET = "2"
ALERT_CPU_CAP = "3"
ALERT_PULL_BILLING = "4"
EMPTY_PAGE_CODE = "NO_RESULTS_ON_PAGE"


def csv_rows(text: str) -> list[tuple[str | None, ...]]:
    """Rows of one of the mapping texts, with empty fields as None."""
    return [tuple(f or None for f in line.split(",")) for line in text.splitlines()]
