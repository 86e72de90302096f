"""Catalogue of the open-data sets: candidate files, target columns, header aliases.

One line per target column: ``name type alias | alias``. Without aliases the header has the target's own name.
Headers match whatever their case. Types: text, int, double, date, moment.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    aliases: tuple[str, ...]


@dataclass(frozen=True)
class Spec:
    name: str
    table: str
    description: str
    files: tuple[str, ...]
    fields: tuple[Field, ...]
    required: tuple[str, ...] = ()
    source_filter: tuple[str, tuple[str, ...]] | None = None
    extra: dict = field(default_factory=dict)


def _fields(text: str) -> tuple[Field, ...]:
    out = []
    for line in text.strip().splitlines():
        name, kind, *rest = line.split(None, 2)
        aliases = tuple(a.strip() for a in rest[0].split("|")) if rest else (name,)
        out.append(Field(name, kind, aliases))
    return tuple(out)


def _files(*stems: str) -> tuple[str, ...]:
    """Each stem as Parquet first, then as CSV."""
    return tuple(f"{stem}.{ext}" for stem in stems for ext in ("parquet", "csv"))


# Complaint types kept when the 311 set is fetched.
SAFETY_COMPLAINTS = (
    "HEATING", "PLUMBING", "GENERAL CONSTRUCTION", "Heat/Hot Water", "ELECTRIC", "Gas Leak", "STRUCTURAL", "SAFETY",
    "Hazardous Materials", "Illegal Conversion", "Building/Use",
)
# Contact roles that count as owners.
OWNER_ROLES = ("HeadOfficer", "IndividualOwner", "CorporateOwner")

# File names and header names of the published sets.
SPECS: dict[str, Spec] = {}


def _add(name: str, table: str, description: str, files: tuple[str, ...], fields: str, **kw) -> None:
    SPECS[name] = Spec(name, table, description, files, _fields(fields), **kw)


_add("pluto", "buildings", "building profiles", _files("Primary_Land_Use_Tax_Lot_Output__PLUTO_", "pluto"), """
bbl text
bin text
borough text
block text block | tax block
lot text lot | tax lot
address text
zipcode text zipcode | postcode
borough_code int borocode
num_floors int numfloors
year_built int yearbuilt
building_class text bldgclass
land_use text landuse
residential_units int unitsres
total_units int unitstotal
lot_area double lotarea
building_area double bldgarea
owner_name text ownername
latitude double
longitude double
""", required=("bbl",))

_add("registrations", "owner_portfolio", "multiple dwelling registrations",
     _files("Multiple_Dwelling_Registrations", "registrations"), """
contact text contactdescription | ownersbusinessname | ownername
registration_id text registrationid
bin text
bbl text
""")

_add("registration_contacts", "owner_portfolio", "registration contacts", _files("registration_contacts"), """
corporation text corporationname
first_name text firstname
last_name text lastname
registration_id text registrationid
role text type | contacttype
""")

_add("dob_violations", "dob_violations", "building violations", _files("dob_violations"), """
bin text
block text
lot text
violation_type text violation_type | violationtype
violation_number text
violation_category text
description text description | violationdescription
disposition_date date disposition_date | dispositiondate
disposition_comments text
issue_date date issue_date | issuedate | isn_dob_bis_viol
""")

_add("dob_safety_violations", "dob_safety_violations", "building safety violations", _files("dob_safety_violations"), """
bin text
violation_number text
violation_type text
violation_description text violation_description | description
issue_date date
status text
""")

_add("dob_ecb_violations", "dob_ecb_violations", "environmental control board violations", _files("dob_ecb_violations"), """
ecb_violation_number text ecb_violation_number | isn_dob_bis_viol
bin text
block text
lot text
violation_type text
violation_description text
infraction_code text
section_law_description text
penalty_imposed double
amount_paid double
balance_due double
hearing_date date hearing_date | hearing_date_time
hearing_status text
served_date date
issue_date date
""")

_add("hpd_violations", "hpd_violations", "housing violations",
     _files("Housing_Maintenance_Code_Violations", "hpd_violations"), """
violation_id int violationid
bin text
building_id int buildingid
borough_id text boroid
block text
lot text
apartment text
story text
violation_class text class | violationclass
inspection_date date inspectiondate
approved_date date approveddate
original_certify_by_date date originalcertifybydate
original_correct_by_date date originalcorrectbydate
new_certify_by_date date newcertifybydate
new_correct_by_date date newcorrectbydate
certified_dismissed_datetime moment certifieddismisseddatetime
order_number text ordernumber
nov_id text novid
nov_description text novdescription
nov_issueddate date novissueddate
current_status text currentstatus
current_status_date date currentstatusdate
""")

_add("hpd_complaints", "hpd_complaints", "housing complaints",
     _files("Housing_Maintenance_Code_Complaints_and_Problems", "hpd_complaints"), """
complaint_id int problemid | complaintid | problem id | complaint id
bin text
building_id int buildingid | building id
borough_id text boroid | borough
block text
lot text
apartment text
status text status | complaint status | problem status
status_date date statusdate | complaint status date | problem status date
complaint_type text type | complainttype
major_category text majorcategoryid | majorcategory | major category
minor_category text minorcategoryid | minorcategory | minor category
code text codeid | code | problem code
problem_description text problemdescription | problem description
status_description text statusdescription
received_date date receiveddate | received date
""")

_add("fire_incidents", "fire_incidents", "fire dispatch", _files("Fire_Incident_Dispatch_Data", "fire_incidents"), """
incident_id text starfire_incident_id
incident_datetime moment
incident_type_desc text
incident_borough text
zipcode text zipcode | zip_code
policeprecinct text
incident_classification text
incident_classification_group text
dispatch_response_seconds int dispatch_response_seconds_qy
incident_response_seconds int incident_response_seconds_qy
incident_travel_seconds int incident_travel_tm_seconds_qy
engines_assigned int engines_assigned_quantity
ladders_assigned int ladders_assigned_quantity
other_units_assigned int other_units_assigned_quantity
latitude double
longitude double
""")

_add("fire_company_incidents", "fire_company_incidents", "fire company responses",
     _files("Incidents_Responded_to_by_Fire_Companies", "fire_company_incidents"), """
im_incident_key text
incident_type_desc text
incident_date_time moment
arrival_date_time moment
last_unit_cleared_date_time moment
highest_alarm_level text
total_incident_duration int
action_taken_primary text action_taken1_desc
action_taken_secondary text action_taken2_desc
property_use_desc text
street_highway text
zip_code text zip_code | zipcode
borough_desc text
floor_of_fire_origin text
below_grade text fire_origin_below_grade
fire_spread_desc text
detector_presence_desc text
aes_presence_desc text
standpipe_system_type_desc text standpipe_sys_present_desc
latitude double
longitude double
""")

_add("ems_incidents", "ems_incidents", "ambulance dispatch", _files("EMS_Incident_Dispatch_Data", "ems_incidents"), """
cad_incident_id text
incident_datetime moment
initial_call_type text
final_call_type text
initial_severity_level text initial_severity_level_code
final_severity_level text final_severity_level_code
incident_disposition text incident_disposition_code
borough text
zipcode text
policeprecinct text
citycouncildistrict text
communitydistrict text
dispatch_response_seconds int dispatch_response_seconds_qy
incident_response_seconds int incident_response_seconds_qy
incident_travel_seconds int incident_travel_tm_seconds_qy
latitude double
longitude double
""")

_add("311_requests", "service_requests_311", "311 safety requests",
     _files("311_Service_Requests_from_2020_to_Present", "311_requests"), """
unique_key text unique_key | uniquekey | unique key
created_date moment created_date | createddate | created date
closed_date moment closed_date | closeddate | closed date
agency text
agency_name text agency_name | agencyname | agency name
complaint_type text complaint_type | complainttype | problem (formerly complaint type)
descriptor text descriptor | problem detail (formerly descriptor)
location_type text location_type | locationtype | location type
incident_zip text incident_zip | incidentzip | incident zip
incident_address text incident_address | incidentaddress | incident address
city text
borough text
latitude double
longitude double
bbl text
status text
resolution_description text resolution_description | resolutiondescription | resolution description
""", source_filter=("complaint_type", SAFETY_COMPLAINTS))

_add("nypd_complaints", "nypd_complaints", "police complaints",
     _files("NYPD_Complaint_Data_Current__Year_To_Date_", "NYPD_complaints"), """
complaint_number text cmplnt_num
complaint_date date cmplnt_fr_dt | rpt_dt
borough text boro_nm
offense_description text ofns_desc
law_category text law_cat_cd
premises_type text prem_typ_desc
police_precinct text addr_pct_cd
latitude double
longitude double
""")

_add("fire_prevention_inspections", "fire_prevention_inspections", "fire prevention inspections",
     _files("fire_prevention_inspections"), """
bin text
address text prem_addr | premisesaddress | address
borough text
inspection_date date last_full_insp_dt | last_visit_dt | inspectiondate
inspection_type text alpha | inspectiontype
result text last_insp_stat | result
violation_description text owner_name | violationdescription | violation_description
certificate_number text acct_num | certificatenumber
expiration_date date last_visit_dt | expirationdate
""")

_add("elevators", "elevators", "elevator devices", _files("DOB_NOW__Build_Elevator_Device_Details", "elevators"), """
bin text
job_filing_number text
device_id text
device_number text devicenumber | device_number
device_type text device_type | devicetype
device_status text device_status | devicestatus | status
floor_from text floorfrom | floor_from
floor_to text floorto | floor_to
speed text
capacity text
approval_date date approvaldate | approval_date
""")

_add("fire_hydrants", "fire_hydrants", "hydrant locations", _files("fire_hydrants"), """
latitude double
longitude double
unitid text
borough text
""")

_add("facilities", "facilities", "city facilities", _files("Facilities_Database", "facilities"), """
uid text
facname text
addressnum text
streetname text
address text
city text
borough text boro | borough
borocode text
zipcode text
factype text
facsubgrp text
opname text
latitude double
longitude double
""")

_add("hospitals", "hospitals", "hospitals", _files("hospitals"), """
facility_name text facname | facility_name | name
factype text factype | facility_type
facsubgrp text
borough text boro | borough
address text
latitude double
longitude double
""")
