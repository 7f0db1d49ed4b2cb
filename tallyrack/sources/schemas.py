"""Explicit schemas, as DDL; published tables are never inferred."""

from __future__ import annotations

SOURCE = "array<struct<url:string,label:string,branch:string,type:string,retrievedAt:timestamp>>"
DAY = "struct<state:string,slots:array<struct<open:string,close:string>>>"

SHOPS = (
    "id string, licenseNumber string, licenseType string, licenseStatus string, operationalStatus string, legalName string, dbaName string, "
    "address struct<line1:string,line2:string,city:string,county:string,borough:string,neighborhood:string,state:string,zip:string>, "
    "geo struct<lat:double,lng:double,precision:string,source:string>, "
    "contact struct<phone:string,email:string,website:string,orderOnlineUrl:string,instagram:string>, "
    f"hours struct<timezone:string,week:map<string,{DAY}>>, services map<string,boolean>, "
    "menu struct<provider:string,menuUrl:string,menuIsPublic:boolean>, "
    "dates struct<licenseIssued:date,licenseEffective:date,licenseExpiration:date,openedOn:date>, "
    f"sources {SOURCE}, verification struct<status:string,confidence:string,verifiedAt:timestamp,checkedAgainstOcmTool:boolean,notes:string>, "
    "warnings array<string>, lastUpdated timestamp"
)

LISTINGS = (
    "listingId string, licenseNumber string, capturedAt timestamp, strainNameRaw string, strainNameCanonical string, brand string, brandKey string, "
    "lineage string, thcPercent double, cbdPercent double, totalCannabinoidsPercent double, "
    "terpenes struct<source:string,profile:array<struct<name:string,rawName:string,percent:double>>,totalPercent:double,labName:string,testedOn:date,coaUrl:string,referenceStrain:string>, "
    "labPanelKey string, packageIds array<string>, harvestedOn date, packagedOn date, expiresOn date, expiresWithinDays int, inStock boolean, "
    f"availableSizesGrams array<double>, productUrl string, description string, sources {SOURCE}, warnings array<string>"
)

MUNICIPALITIES = (
    f"id string, name string, kind string, county string, retailOptOut boolean, onsiteConsumptionOptOut boolean, optOutDate date, notes string, sources {SOURCE}, lastUpdated timestamp"
)

PRODUCERS = (
    "id string, licenseNumber string, licenseType string, licenseStatus string, operationalStatus string, entityName string, counties array<string>, regions array<string>, "
    "locationCount int, cultivation struct<indoor:boolean,outdoor:boolean,mixedLight:boolean,combination:boolean>, "
    "brands array<struct<name:string,match:string,listingCount:int,shopCount:int>>, dates struct<licenseIssued:date,licenseExpiration:date>"
)

STRAIN_REFERENCE = (
    "strainId string, canonicalName string, aliases array<string>, lineage string, profile array<struct<name:string,rawName:string,medianPercent:double,observations:int>>, "
    "basis struct<kind:string,sampleCount:int,datasetName:string,datasetLicence:string>, confidence string"
)

PACKAGES = (
    "tag string, found boolean, facility string, product string, strain string, packaged date, tested date, harvested date, lab string, batchTag string, thc double, cbd double, "
    "terpenesTotal double, terpenes map<string,double>, labLicense string, labDoc string, coaFile boolean, checked date"
)

CERTIFICATES = (
    "url string, lab string, unread string, sampleId string, batchTag string, lotNumber string, metrcTag string, sampled date, sampledFrom string, packaged date, packagedFrom string, "
    "harvested date, harvestedFrom string, sha256 string, docType string, panel struct<lab:string,name:string,matrix:string,licence:string,thc:double,totalTerpenes:double,terpenes:map<string,double>>"
)
