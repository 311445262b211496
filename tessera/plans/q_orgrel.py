"""Organization relationship queries (JOIN-14..16)."""

from __future__ import annotations

from tessera.operators.org_relations import matches_resolved, org_relationships, relationships_resolved
from tessera.plans.catalog import register


def _orgs(I):
    from tessera.plans.q_geo import _orgs as base
    from tessera.sources.proxies_orgs import linked_orgs
    return linked_orgs(base(I))


_REL_SQL = """
WITH numbered AS (SELECT *, record_id::INTEGER AS rid FROM orgs),
named AS (SELECT * REPLACE (CASE collection WHEN 'incubadoras' THEN 'incubators' WHEN 'aceleradoras' THEN 'accelerators'
             WHEN 'parques' THEN ['operationParks', 'implantationParks', 'planningParks'][rid % 3 + 1]
             WHEN 'empresas' THEN ['incubatedCompanies', 'graduatedCompanies'][rid % 2 + 1]
             ELSE ['residentCompanies', 'acceleratedCompanies', 'others'][rid % 3 + 1] END AS collection),
           ['App\\Models\\Incubator', 'App\\Models\\Accelerator', 'App\\Models\\Park', NULL][rid % 4 + 1] AS linkable_type,
           CASE WHEN rid % 4 < 3 THEN ((rid + 1) % 150)::VARCHAR END AS linkable_id FROM numbered),
child AS (SELECT manifest_id, id AS child_organization_id, collection AS child_collection,
                 coalesce(MAP {'incubatedCompanies': 'incubated_by', 'acceleratedCompanies': 'accelerated_by',
                               'graduatedCompanies': 'graduated_from', 'residentCompanies': 'resident_in'}[collection], 'linked_to')
                   AS relationship_type, linkable_type, linkable_id
          FROM named WHERE linkable_type IS NOT NULL AND linkable_id IS NOT NULL),
cand AS (SELECT 'App\\Models\\' || m AS linkable_type, c AS parent_collection, o AS cand_order FROM (VALUES ('Incubator', 'incubators', 0), ('Accelerator', 'accelerators', 0),
            ('Park', 'operationParks', 0), ('Park', 'implantationParks', 1), ('Park', 'planningParks', 2)) v(m, c, o)),
parents AS (SELECT manifest_id, collection AS parent_collection, record_id AS linkable_id, max(id) AS parent_organization_id
            FROM named GROUP BY 1, 2, 3),
best AS (SELECT child_organization_id, relationship_type, parent_organization_id FROM (
           SELECT c.child_organization_id, c.relationship_type, p.parent_organization_id,
                  row_number() OVER (PARTITION BY c.child_organization_id, c.relationship_type ORDER BY k.cand_order) AS rn
           FROM child c JOIN cand k ON k.linkable_type = c.linkable_type
           JOIN parents p ON p.manifest_id = c.manifest_id AND p.parent_collection = k.parent_collection
                         AND p.linkable_id = c.linkable_id) t WHERE rn = 1),
rels AS (SELECT c.manifest_id, c.child_organization_id, c.relationship_type, c.linkable_type AS parent_model_class,
                c.linkable_id AS parent_source_record_id, b.parent_organization_id, c.child_collection
         FROM child c LEFT JOIN best b ON b.child_organization_id = c.child_organization_id
                                       AND b.relationship_type = c.relationship_type)
"""

register("org_relationships", _REL_SQL + """
SELECT manifest_id, child_organization_id, relationship_type, parent_model_class, parent_source_record_id,
       parent_organization_id FROM rels
""")(lambda I: org_relationships(_orgs(I)).drop("relationship_metadata"))

register("relationships_resolved", _REL_SQL + """
SELECT r.manifest_id, r.child_organization_id, r.relationship_type, r.parent_model_class, r.parent_source_record_id,
       r.parent_organization_id, c.nome AS child_nome, p.nome AS parent_nome, p.collection AS parent_collection
FROM rels r JOIN named c ON c.id = r.child_organization_id LEFT JOIN named p ON p.id = r.parent_organization_id
""")(lambda I: relationships_resolved(org_relationships(_orgs(I)).drop("relationship_metadata"), _orgs(I)))


def _matches_resolved(I):
    from tessera.operators import orgs as OR
    from tessera.plans.q_geo import _latest
    m = OR.match_orgs(OR.seed_matches(_latest(I)), I.establishments, I.companies).drop("evidence")
    return matches_resolved(m, _latest(I), I.companies, I.establishments).select(
        "collection", "record_id", "cnpj_14", "status", "nome", "razao_social", "situacao_cadastral", "uf")


register("matches_resolved", """
SELECT s.collection, s.record_id, s.cnpj_14,
  CASE WHEN s.status = 'invalid' THEN 'invalid' WHEN e.cnpj_basico IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS status,
  o.nome, c.razao_social, e.situacao_cadastral, e.uf
FROM org_seeds s JOIN orgs_latest o ON o.collection = s.collection AND o.record_id = s.record_id
LEFT JOIN empresa c ON c.cnpj_basico = left(s.cnpj_14, 8)
LEFT JOIN estab e ON e.cnpj_basico = s.cnpj_basico AND e.cnpj_ordem = s.cnpj_ordem AND e.cnpj_dv = s.cnpj_dv
""")(_matches_resolved)
